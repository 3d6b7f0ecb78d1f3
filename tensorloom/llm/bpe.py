"""Byte-pair encoding and decoding with a contiguous rank array.

A text is cut at special tokens, then into words by the byte-level pattern. A word's bytes start
as one part each; the array beside them holds, for each boundary, the rank of the pair that meets
there. The least rank is looked for by scanning the array, its boundary is deleted and the ranks
on both sides are looked up anew, until no pair has a rank. Scanning is quadratic in the word's
length and fastest for short words; beyond ``LONG`` bytes a heap over linked parts finds the same
minimum, leftmost first, in n log n.

Both directions run as Arrow batches (:func:`encode`, :func:`decode`); the vocabulary is read once
per Python worker from a path that every executor has. Each worker remembers up to ``MEMORY``
words, so memory stays bounded. No shuffle: rows are
independent.

Ids are carried as little-endian unsigned 32-bit numbers in one binary value per text
(:func:`as_array` turns them into an array). Defined results: a null text counts as empty and has
no ids; decoding ids that are not whole UTF-8 gives the replacement character, as usual for this
decoder; a null id value decodes to the empty text. Other columns pass through by name.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.llm.scratch import for_workers

#: Longest word in bytes that is merged by scanning.
LONG = 64
#: Words remembered by one worker.
MEMORY = 240_000
#: The byte-level pattern (fixed value of the vocabulary's pre-tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def public_vocabulary() -> str:
    """Path of the installed public 50k vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes are
    themselves, the others follow in order from code point 256."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Words(dict):
    """Word to packed ids; a word that is missing is encoded and kept.

    Two generations of ``MEMORY / 2`` words: a full one becomes the old one, and words that are met
    again move to the new one, so frequent words stay while memory is bounded.
    """

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.old = codec, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMORY // 2:
            self.old = dict(self)
            self.clear()
        got = self.old.get(word)
        got = self[word] = self.codec.word(word.encode()) if got is None else got
        return got


class Codec:
    """The vocabulary of one file, with its merges and special tokens."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.start = [vocab[c] for c in letters]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.known = Words(self)

    def word(self, word: bytes) -> bytes:
        ids = [self.start[b] for b in word]
        ids = self.scan(ids) if len(ids) <= LONG else self.heap(ids)
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def scan(self, parts: list[int]) -> list[int]:
        """Merge by the contiguous rank array."""
        none = (1 << 60, 0)
        get = self.pairs.get
        meets = [get(p, none) for p in zip(parts, parts[1:], strict=False)]
        while meets:
            best = min(meets)
            if best is none:
                break
            i = meets.index(best)  # the leftmost
            parts[i : i + 2] = [best[1]]
            del meets[i]
            if i:
                meets[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(meets):
                meets[i] = get((parts[i], parts[i + 1]), none)
        return parts

    def heap(self, parts: list[int]) -> list[int]:
        """The same merges for a long word: a heap of (rank, place) over linked parts."""
        n, get = len(parts), self.pairs.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue = [(m[0], i, parts[i], parts[i + 1], m[1]) for i in range(n - 1) if (m := get((parts[i], parts[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, left, right, made = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != left or parts[j] != right:
                continue
            parts[i], alive[j], after[i] = made, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if a >= 0 and b < n and (m := get((parts[a], parts[b]))):
                    heapq.heappush(queue, (m[0], a, parts[a], parts[b], m[1]))
        return [p for p, live in zip(parts, alive, strict=True) if live]

    def encode(self, text: str) -> bytes:
        known = self.known.__getitem__
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(map(known, self.find(text)))
        out = []
        for piece in self.cut(text):
            if piece in self.special:
                out.append(self.special[piece].to_bytes(4, "little"))
            else:
                out.extend(map(known, self.find(piece)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        import numpy as np

        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The path's vocabulary, read once per process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _mapped(df: DataFrame, column: str, made: list[tuple[str, T.DataType, pa.DataType]], one) -> DataFrame:
    """``df`` with the columns ``made`` added: ``one(value)`` of each value of ``column``, by Arrow batches."""
    for_workers(df.sparkSession)
    new = [m[0] for m in made]
    if taken := sorted(set(new) & set(df.columns)):
        raise ValueError(f"the input has columns of these names already: {taken}; pass other names for the new ones")
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, kind) for n, kind, _ in made]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few rows at a time: what is made is held in pieces that follow the texts' length.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                values = [one(x) for x in part.column(part.schema.get_field_index(column)).to_pylist()]
                arrays = [pa.array([v[i] for v in values], arrow) for i, (_, _, arrow) in enumerate(made)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *new])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, decoded: str | None = None) -> DataFrame:
    """``df`` with the ids of ``text`` in the binary column ``out``.

    ``decoded`` names a column for the text that the ids decode to, made in the same pass. Other
    columns pass through; an input column with the name of a new one is a ValueError, so none is lost.
    """
    path = path or public_vocabulary()
    ids = (out, T.BinaryType(), pa.binary())
    if decoded is None:
        return _mapped(df, text, [ids], lambda x: (codec(path).encode(x or ""),))
    both = lambda x: ((raw := codec(path).encode(x or "")), codec(path).decode(raw))
    return _mapped(df, text, [ids, (decoded, T.StringType(), pa.string())], both)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the text of the binary column ``ids`` in the string column ``out``."""
    path = path or public_vocabulary()
    return _mapped(df, ids, [(out, T.StringType(), pa.string())], lambda x: (codec(path).decode(x or b""),))


def n_tokens(ids: str = "ids") -> Column:
    """The number of ids in a binary value."""
    return (F.octet_length(ids) / 4).cast("long")


def as_array(ids: str = "ids") -> Column:
    """The ids as an array of ints."""
    digits = F.regexp_extract_all(F.hex(ids), F.lit("(..)(..)(..)(..)"), F.lit(0))
    number = lambda h: F.conv(F.concat(*[F.substring(h, p, 2) for p in (7, 5, 3, 1)]), 16, 10).cast("int")
    return F.transform(digits, number)
