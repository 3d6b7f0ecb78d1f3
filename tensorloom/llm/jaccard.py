r"""N-gram Jaccard join by a token-group matrix.

Documents are sets of distinct word shingles (64-bit hashes of ``k`` lower-cased words). Two sets
link when ``100 * intersection >= threshold * union``; the operator gives the components of the
links. It loses no link between different texts and emits no pairs within a group of copies.

1. *Classes.* Documents with equal sets are one class from the start (a 128-bit digest of the set),
   so copies cost one row each, whatever their number.
2. *Groups.* Similar classes are put together by the least hash of their set that is not frequent
   (two sets agree in it with about the probability of their similarity) and the band of its size,
   in groups of ``GROUP_ROWS`` classes or so.
3. *Matrix.* For each group the union of its classes' prefix tokens is stored, one row per token
   and group. The prefix of a set of ``n`` are its first ``n - a + l`` tokens in one global order,
   where ``a`` is the least intersection that a link needs and ``l = min(LEAST_SHARED, a)``: two
   linked sets share at least ``l`` prefix tokens. Tokens that more than ``FREQUENT`` documents have
   in their prefix (passages that many documents share) come last in the order, the more documents
   the later, so they leave the prefixes of all but the texts made of them, and those keep the rarest
   of them. The order is a matter of speed, never of the result.
4. *Bound.* The matrix is joined with itself on the token, for groups whose sizes allow a link.
   Groups that share too few tokens cannot hold one and stay closed for each other: ``l`` at least, more
   where their sizes are alike (``_size_bounds``). The others form clusters. Tokens that more than
   ``HOT`` groups share (near copies by the thousand) give no pairs. A pair that shares another token too is
   credited with all the hot ones that it can have; one that shares hot tokens only shares ``l`` of
   them, so groups with as many get an edge to the first such group of each of their hot tokens.
5. *Opening.* Only the texts of groups that qualify are read again, once each. Inside a cluster a
   set opens a group only if its overlap with the union of the group's whole sets reaches ``a`` and
   a member is not connected to it yet; the comparison is exact on whole sets. A spanning forest of
   the links found goes on to the components, so near copies by the thousand give one row each.

Scale: the text is scanned twice (order, matrix) without a shuffle; what is shuffled are about 16 %
of the tokens, as fixed-width rows, and the sets of documents that have a candidate. Broadcasts are
of counted size: the frequent tokens (``MOST_FREQUENT`` at most, 9 bytes each; the frequency that counts as
frequent rises until they fit) and lists of copies, groups and candidates up to ``BROADCAST_ROWS``
rows, beyond which they are joined by shuffles. The candidates' texts are found by a bitmap of their marks
before that (``_sieved``). Each step's shuffle files go when it is written. A cluster of more than ``UNIT_ROWS`` classes or
``UNIT_TOKENS`` tokens is cut into bands by the size of the sets and the bands into blocks. Sizes of
linked sets differ by the threshold at most, so only blocks of one band or of neighbouring bands are
compared, by pairs, each a task of bounded memory: texts of all lengths that a common passage chains
into one cluster do not all meet. Where sets go to more than ``SENT`` pairs on average, the pairs are
compared in rounds, so the disk holds a bounded multiple of the sets, however large the clusters.

Defined results: a text with fewer than ``k`` words is one shingle, its whole sequence of words. A
null text or one without words has an empty set, links with nothing and is its own component.
Repeated rows are one class. A component's id is the least key of its rows, nulls left out. Hashes
of 64 bits stand for shingles: two given texts of a thousand shingles are misjudged by a collision
with a probability of about 1e-13. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.components import components
from tensorloom.llm.scratch import for_workers, freed

#: Shared prefix tokens that a pair of groups needs before it is opened.
LEAST_SHARED = 4
#: A token in the prefix of more documents than this comes last in the order.
FREQUENT = 50
#: A token in more groups than this links them into one cluster instead of giving pairs.
HOT = 64
#: Frequent tokens that are broadcast at most (9 bytes each).
MOST_FREQUENT = 1_000_000
#: Classes in one group, about.
GROUP_ROWS = 256
#: Classes in one block of a cluster, about; a task compares two blocks at most.
UNIT_ROWS = 1024
#: Tokens (8 bytes each) of a block, about, where its sets are long.
UNIT_TOKENS = 1_000_000
#: Rows (under 40 bytes each) of a side that is broadcast at most.
BROADCAST_ROWS = 500_000
#: Bits of the map of candidates that is broadcast where there are more of them (16 MB).
SIEVE_BITS = 1 << 27
#: Times that a set is sent to units in one round, on average.
SENT = 4
#: Bytes of a text whose words are hashed in one go, and the length beyond which a word is hashed on its own.
PIECE, LONG_WORD = 1 << 20, 255

#: The pairs of blocks that a set takes part in.
UNITS = "array<struct<lower:int,low:int,upper:int,high:int,side:int>>"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class _Powers:
    """Powers of an odd number and of its inverse by 2**64, and random values for bytes; made once a worker."""

    def __init__(self):
        rng = np.random.Generator(np.random.PCG64(7))
        self.values = rng.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        base = 0xD6E8FEB86659FD93
        run = lambda x: np.concatenate([[np.uint64(1)], np.cumprod(np.full(PIECE, x, np.uint64))])
        self.up, self.down = run(base), run(pow(base, -1, 2**64))


_powers: list[_Powers] = []


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of lower-cased bytes, in order.

    A word's hash is a polynomial in its bytes' values, taken from running sums over the whole piece.
    Words of more than ``LONG_WORD`` bytes, for which such sums can be made to collide, get another hash.
    """
    import xxhash

    p = _powers[0] if _powers else _powers.append(_Powers()) or _powers[0]
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        if end < len(raw):
            cut = np.flatnonzero(_BLANK[raw[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:  # a word longer than a piece ends at the next blank
                more = (i for i in range(end, len(raw), PIECE) if _BLANK[raw[i : i + PIECE]].any())
                first = next(more, None)
                end = len(raw) if first is None else first + int(np.argmax(_BLANK[raw[first : first + PIECE]]))
                out.append(np.array([xxhash.xxh64_intdigest(raw[at:end].tobytes())], np.uint64))
                at = end
                continue
        piece = raw[at:end]
        edge = np.diff(np.concatenate([[True], _BLANK[piece], [True]]).view(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(p.values[piece] * p.up[: len(piece)], out=sums[1:])
        hashes = (sums[last] - sums[first]) * p.down[first] + (last - first).astype(np.uint64) * _ODD
        hashes ^= hashes >> np.uint64(32)
        for i in np.flatnonzero(last - first > LONG_WORD):
            hashes[i] = xxhash.xxh64_intdigest(piece[first[i] : last[i]].tobytes())
        out.append(hashes)
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def distinct(tokens: np.ndarray) -> np.ndarray:
    """The array's values once each, in rising order; sorts it in place."""
    tokens.sort()
    return tokens[np.concatenate([[True], tokens[1:] != tokens[:-1]])] if len(tokens) else tokens


def shingles(text: str | None, k: int) -> np.ndarray:
    """The text's distinct shingle hashes, in rising order."""
    hashes = word_hashes(np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8))
    if not len(hashes):
        return hashes
    n = min(k, len(hashes))
    count = len(hashes) - n + 1
    out = np.full(count, n, np.uint64)
    for i in range(n):
        out ^= hashes[i : i + count]
        out *= _ODD
        out ^= out >> _SHIFT
    return distinct(out)


def needed(n, threshold: int):
    """The least intersection with which a set of ``n`` can link at all."""
    return -(-threshold * n // 100)


def _size_bounds(lo: str, hi: str, low: str, high: str, threshold: int) -> tuple[Column, Column]:
    """Whether sets of ``lo`` to ``hi`` and of ``low`` to ``high`` tokens can link, and the prefix tokens they then share.

    Linked sets of ``m <= n`` tokens share ``o >= threshold * (m + n) / (100 + threshold)``. Their first
    ``k`` common tokens are among the first ``n - o + k`` of both, so those up to ``k = o - a + l`` are in
    both prefixes; that is ``l`` where ``m`` is as small as a link allows, and far more for like sizes.
    """
    can = (F.col(hi) * 100 >= F.col(low) * threshold) & (F.col(high) * 100 >= F.col(lo) * threshold)
    least = F.least(F.lit(LEAST_SHARED), F.ceil(F.least(lo, low) * threshold / 100))
    spare = F.least(F.col(low) * 100 - F.col(hi) * threshold, F.col(lo) * 100 - F.col(high) * threshold)
    return can, least + F.greatest(F.lit(0), F.floor(spare * threshold / (100 * (100 + threshold))))


def prefix_length(n: int, threshold: int) -> int:
    """The prefix's length."""
    a = needed(n, threshold)
    return n - a + min(LEAST_SHARED, a)


def _columns(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _prefix_tokens(docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """tokens: the prefix of each document by hash alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingles(t, k) for t in _columns(batch, "text")[0].to_pylist()]
            yield pa.RecordBatch.from_arrays([_lists([s[: prefix_length(len(s), threshold)] for s in sets])], names=["tokens"])

    return docs.select("text").mapInArrow(run, "tokens array<bigint>")


def _frequent(docs: DataFrame, k: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that come last in the order, sorted, at most ``MOST_FREQUENT``, and the class of each.

    The class is the power of two in the token's number of documents.
    """
    counts = _prefix_tokens(docs, k, threshold).select(F.explode("tokens").alias("token")).groupBy("token").count()
    counts = freed(counts.where(F.col("count") > FREQUENT), "frequent")
    least, left = FREQUENT, counts.count()
    while left > MOST_FREQUENT:
        least *= 2
        left = counts.where(F.col("count") > least).count()
    found = counts.where(F.col("count") > least).select("token", F.floor(F.log2(F.col("count"))).cast("byte").alias("class")).toPandas()
    tokens = found["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], found["class"].to_numpy(np.int8)[order]


def _sketches(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], k: int, threshold: int) -> DataFrame:
    """key, mark, n, digest, least, tokens (the prefix) of each document."""
    import hashlib

    held = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, classes = held.value
        for batch in _slices(batches):
            key, mark, text = _columns(batch, "key", "mark", "text")
            sets = [shingles(t, k) for t in text.to_pylist()]
            prefixes, least = [], []
            for s in sets:
                length = prefix_length(len(s), threshold)
                at = np.minimum(np.searchsorted(last, s), max(len(last) - 1, 0))
                often = last[at] == s if len(last) else np.zeros(len(s), bool)
                rest = s[~often]
                few = rest[:length]
                least.append(int((rest if len(rest) else s)[:1].view(np.int64)[0]) if len(s) else None)
                if len(few) < length:
                    rarest = np.argsort(classes[at[often]], kind="stable")[: length - len(few)]
                    few = np.concatenate([few, s[often][rarest]])
                prefixes.append(few)
            yield pa.RecordBatch.from_arrays(
                [
                    key, mark, pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array(least, pa.int64()), _lists(prefixes),
                ],
                names=["key", "mark", "n", "digest", "least", "tokens"],
            )

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, mark bigint, n bigint, digest binary, least bigint, tokens array<bigint>")


def _small(df: DataFrame) -> DataFrame:
    """A written table, with a broadcast hint if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _sieved(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose mark is in ``marks(m)``, and maybe a few more; their texts are not shuffled.

    Up to ``BROADCAST_ROWS`` marks are broadcast, up to an eighth of ``SIEVE_BITS`` a bitmap of so many
    bits, in rows of 4 KB; only more than that are joined by a shuffle.
    """
    count = marks.count()
    if count <= BROADCAST_ROWS or count > SIEVE_BITS // 8:
        return docs.join(_small(marks), F.col("mark") == F.col("m"), "left_semi")
    slot, row = (lambda of: F.pmod(F.col(of), F.lit(SIEVE_BITS))), 1 << 15
    maps = marks.groupBy(F.floor(slot("m") / row).alias("r")).agg(F.bitmap_construct_agg(slot("m") % row).alias("bits"))
    maps = freed(maps, "maps")
    at = slot("mark") % row
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = docs.join(F.broadcast(maps), F.floor(slot("mark") / row) == F.col("r"))
    return found.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*docs.columns)


def _whole_sets(docs: DataFrame, k: int) -> DataFrame:
    """digest, n, tokens (packed) of each document."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            packed = [s.tobytes() for t in _columns(batch, "text")[0].to_pylist() if len(s := shingles(t, k))]
            digests = [hashlib.blake2b(p, digest_size=16).digest() for p in packed]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], names=["digest", "set"])

    return docs.select("text").mapInArrow(run, "digest binary, set binary")


def open_unit(left: list[tuple], right: list[tuple] | None, threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two lists of (group, set), or within one list.

    Places count the left list first. A left set opens a group of the right list if its overlap with
    the union of that group's sets reaches what it needs and some member is not yet connected to it.
    """
    own = right is None
    right = left if own else right
    shift = 0 if own else len(left)
    by_group: dict[int, list[int]] = {}
    for j, (group, _) in enumerate(right):
        by_group.setdefault(group, []).append(j)
    groups = []
    for places in by_group.values():
        union, flat = np.unique(np.concatenate([right[j][1] for j in places]), return_inverse=True)
        sizes = np.array([len(right[j][1]) for j in places])
        groups.append((np.array(places), union, flat, np.cumsum(sizes) - sizes, sizes))
    tokens, every = np.unique(np.concatenate([g[1] for g in groups]), return_inverse=True)
    lengths = np.array([len(g[1]) for g in groups])
    starts = np.cumsum(lengths) - lengths
    label = np.arange(shift + len(right))
    seen, out = np.zeros(len(tokens), bool), []
    for i, (_, s) in enumerate(left):
        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
        at = at[tokens[at] == s]
        if len(at) < needed(len(s), threshold):
            continue
        seen[at] = True
        bound = np.add.reduceat(seen[every], starts, dtype=np.int64)
        for g in np.flatnonzero(bound >= needed(len(s), threshold)).tolist():
            places, _, flat, begin, sizes = groups[g]
            if (label[places + shift] == label[i]).all():
                continue
            inside = seen[every[starts[g] : starts[g] + lengths[g]]]
            both = np.add.reduceat(inside[flat], begin, dtype=np.int64)
            for j in places[100 * both >= threshold * (len(s) + sizes - both)].tolist():
                a, b = label[i], label[j + shift]
                if a != b:
                    label[label == max(a, b)] = min(a, b)
                    out.append((i, j + shift))
        seen[at] = False
    return out


def _links(members: DataFrame, threshold: int, rounds: int = 1) -> DataFrame:
    """a, b: links inside the clusters of ``members(cluster, band, block, blocks, before, after, group, digest, set)``.

    ``blocks``, ``before`` and ``after`` are the blocks of the set's band and of the bands next to it.
    In several rounds the sets are written once, and each round sends them to its share of the units.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["side", "digest"]).sort_values(["side", "group", "digest"])
        sides = [[(g, np.frombuffer(x, np.uint64)) for g, x in zip(p["group"], p["set"], strict=True)] for p in (pdf[pdf["side"] == 0], pdf[pdf["side"] == 1])]
        own, digests = bool((pdf["low"].iloc[0], pdf["lower"].iloc[0]) == (pdf["high"].iloc[0], pdf["upper"].iloc[0])), pdf["digest"].tolist()
        if not sides[0] or (not own and not sides[1]):
            return pd.DataFrame({"a": [], "b": []})
        found = open_unit(sides[0], None if own else sides[1], threshold)
        return pd.DataFrame({"a": [digests[i] for i, _ in found], "b": [digests[j] for _, j in found]})

    # A cluster of one block is one unit; of more, each pair of blocks whose sets can link is one.
    def units(blocks: str, of) -> Column:
        return F.when(F.col(blocks) > 0, F.transform(F.sequence(F.lit(0), F.col(blocks) - 1), of)).otherwise(F.array().cast(UNITS))

    def unit(lower, low, upper, high, side) -> Column:
        return F.struct(lower.alias("lower"), low.alias("low"), upper.alias("upper"), high.alias("high"), side.alias("side"))

    band, block, zero, one = F.col("band"), F.col("block"), F.lit(0), F.lit(1)
    inside = units("blocks", lambda o: unit(band, F.least(block, o), band, F.greatest(block, o), F.when(block > o, one).otherwise(zero)))
    after = units("after", lambda o: unit(band, block, band + 1, o, zero))
    before = units("before", lambda o: unit(band - 1, o, band, block, one))
    rows = members.select("cluster", F.explode(F.concat(inside, after, before)).alias("u"), "group", "digest", "set")
    rows = rows.select("cluster", "u.*", "group", "digest", "set")
    unit_key = ["cluster", "lower", "low", "upper", "high"]
    found = lambda part: part.groupBy(*unit_key).applyInPandas(run, "a binary, b binary")
    if rounds == 1:
        return found(rows)
    share = F.pmod(F.xxhash64(*unit_key), F.lit(rounds))
    return reduce(DataFrame.unionByName, [freed(found(rows.where(share == i)), "found") for i in range(rounds)])


def _rounds(inside: DataFrame) -> int:
    """The rounds in which ``_links`` sends a set to ``SENT`` units each, on average by bytes."""
    units = F.col("blocks") + F.col("before") + F.col("after")
    whole, sent = inside.agg(F.sum("n"), F.sum(F.col("n") * units)).first()
    return max(1, -(-sent // (SENT * whole))) if whole else 1


def _band(threshold: int) -> Column:
    """The band of size ``n``: a little wider than sizes of linked sets are apart, so these are in one band or in neighbouring ones."""
    width = max(1.001 * math.log(100 / max(threshold, 1)), 0.001)
    return F.floor(F.log("n") / F.lit(width)).cast("int")


def _placed(inside: DataFrame, threshold: int) -> DataFrame:
    """``inside(cluster, n, group, digest)`` with the columns that ``_links`` needs.

    Clusters of one block keep one band.
    """
    size = F.greatest(F.ceil(F.count("*") / F.lit(UNIT_ROWS)), F.ceil(F.sum("n") / F.lit(UNIT_TOKENS))).cast("int").alias("blocks")
    large = freed(inside.groupBy("cluster").agg(size).where(F.col("blocks") > 1).select(F.col("cluster").alias("c")), "large")
    if large.isEmpty():
        return inside.withColumns({"band": F.lit(0), "block": F.lit(0), "blocks": F.lit(1), "before": F.lit(0), "after": F.lit(0)})
    inside = inside.join(_small(large), F.col("cluster") == F.col("c"), "left")
    inside = inside.withColumn("band", F.when(F.col("c").isNotNull(), _band(threshold)).otherwise(F.lit(0)))
    bands = inside.where(F.col("c").isNotNull()).groupBy(F.col("cluster").alias("k"), F.col("band").alias("b")).agg(size)
    # A cluster has few bands: their number grows with the logarithm of the longest text.
    order = Window.partitionBy("k").orderBy("b")
    beside = lambda of, step: F.when(of("b").over(order) == F.col("b") + step, of("blocks").over(order))
    bands = freed(bands.select("k", "b", F.col("blocks").alias("__blocks"), beside(F.lag, -1).alias("__before"), beside(F.lead, 1).alias("__after")), "bands")
    inside = inside.join(_small(bands), (F.col("cluster") == F.col("k")) & (F.col("band") == F.col("b")), "left")
    inside = inside.withColumns({"blocks": F.coalesce("__blocks", F.lit(1)), "before": F.coalesce("__before", F.lit(0)), "after": F.coalesce("__after", F.lit(0))})
    block = F.pmod(F.xxhash64("group", F.when(F.col("blocks") > 1, F.col("digest"))), F.col("blocks")).cast("int")
    return inside.select("digest", "mark", "n", "group", "cluster", "band", block.alias("block"), "blocks", "before", "after")


def _edges(common: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """a, b: the pairs of groups that can hold a link and share a token that is not hot, and the edges for the others.

    ``common(token, group, lo, hi, n)``: the groups of a token, ``n`` of them, with the least and the
    largest size of their sets that hold it. A pair that shares only hot tokens shares at least ``l``
    of them, so groups with fewer have no such pair.
    """
    warm = common.where(F.col("n") > HOT)
    heat = freed(warm.groupBy(F.col("group").alias("g")).agg(F.count("*").alias("heat"), F.min("lo").alias("least")), "heat")
    cool = common.where(F.col("n") <= HOT).join(_small(heat), F.col("group") == F.col("g"), "left")
    cool = cool.select("token", "group", "lo", "hi", F.coalesce("heat", F.lit(0)).alias("heat"))
    other = cool.select("token", F.col("group").alias("other"), F.col("lo").alias("low"), F.col("hi").alias("high"), F.col("heat").alias("also"))
    can, must = _size_bounds("lo", "hi", "low", "high", threshold)
    pairs = cool.join(other, "token").where((F.col("group") < F.col("other")) & can)
    # What the two can share besides: the hot tokens of the one that has fewer.
    pairs = pairs.groupBy("group", "other").agg(F.count("*").alias("n"), F.min(must - F.least("heat", "also")).alias("must"))
    pairs = freed(pairs.where(F.col("n") >= F.col("must")).select(F.col("group").alias("a"), F.col("other").alias("b")), "pairs")
    enough = heat.where(F.col("heat") >= F.least(F.lit(LEAST_SHARED), F.ceil(F.col("least") * threshold / 100))).select("g")
    warm = warm.join(_small(freed(enough, "enough")), F.col("group") == F.col("g"), "left_semi")
    centers = _small(freed(warm.groupBy(F.col("token").alias("t")).agg(F.min("group").alias("b")), "centers"))
    return pairs, freed(warm.join(centers, F.col("token") == F.col("t")).select(F.col("group").alias("a"), "b").distinct(), "hot")


def _clustered(groups: DataFrame, edges: DataFrame, kind: int) -> DataFrame:
    """o, cluster: the groups ``o`` by the component of their edges."""
    of = groups.join(components(edges), F.col("o") == F.col("node"), "left")
    return of.select("o", F.xxhash64(F.coalesce("root", "o"), F.lit(kind)).alias("cluster"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, threshold: int = 85) -> DataFrame:
    """Key, n_shingles, component_id and ``class`` (the set's digest): one row per row of ``docs``."""
    for_workers(docs.sparkSession)
    docs = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(key).cast("string")).alias("mark"), F.col(text).cast("string").alias("text"))
    sketch = freed(_sketches(docs, _frequent(docs, k, threshold), k, threshold), "sketches")
    full = sketch.where(F.col("n") > 0)
    # 1. Classes, and of each the document that stands for it.
    classes = freed(full.groupBy("digest").agg(F.min("key").alias("first"), F.min("mark").alias("mark"), F.count("*").alias("copies")), "classes")
    copied = freed(classes.where(F.col("copies") > 1).select(F.col("digest").alias("d"), F.col("mark").alias("m")), "copied")
    nodes = full.join(_small(copied), F.col("digest") == F.col("d"), "left").where(F.col("m").isNull() | (F.col("m") == F.col("mark")))
    # 2. Groups by the least hash and the band of the size, in chunks of bounded size.
    nodes = nodes.withColumn("alike", F.xxhash64("least", _band(threshold)))
    sizes = freed(nodes.groupBy(F.col("alike").alias("l")).agg(F.count("*").alias("size")).where(F.col("size") > 1), "sizes")
    chunk = F.pmod(F.xxhash64("digest"), F.ceil(F.col("size") / F.lit(GROUP_ROWS)))
    group = F.when(F.col("size").isNull(), F.col("alike")).otherwise(F.xxhash64("alike", chunk))
    nodes = nodes.join(_small(sizes), F.col("alike") == F.col("l"), "left")
    nodes = nodes.select("digest", "mark", "n", group.alias("group"), F.col("size").isNotNull().alias("many"), "tokens")
    # 3. The matrix: one row per token and group.
    cells = nodes.select(F.explode("tokens").alias("token"), "group", "n", "many")
    matrix = cells.where(~F.col("many")).select("token", "group", F.col("n").alias("lo"), F.col("n").alias("hi"))
    matrix = matrix.unionByName(cells.where("many").groupBy("token", "group").agg(F.min("n").alias("lo"), F.max("n").alias("hi")))
    # 4. The bound: groups that share enough tokens. Tokens of one group only are gone after this.
    counts = matrix.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    common = freed(matrix.join(counts, "token"), "common")
    pairs, hot = _edges(common, threshold)
    # 5. Opening: groups that qualify for each other form clusters, whose texts are read again.
    many = nodes.where("many").groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > 1).select(F.col("group").alias("o"))
    opened = _clustered(pairs.select(F.explode(F.array("a", "b")).alias("o")).unionByName(many).distinct(), pairs, 0)
    opened = opened.unionByName(_clustered(hot.select(F.explode(F.array("a", "b")).alias("o")).distinct(), hot, 1))
    inside = nodes.select("digest", "mark", "n", "group").join(_small(freed(opened, "opened")), F.col("group") == F.col("o")).drop("o").distinct()
    inside = freed(inside, "inside")
    inside = freed(_placed(inside, threshold), "placed")
    marks = freed(inside.select(F.col("mark").alias("m")).distinct(), "marks")
    texts = _sieved(docs, marks)
    members = _whole_sets(texts, k).join(_small(inside), "digest")
    rounds = _rounds(inside)
    links = components(_links(freed(members, "members") if rounds > 1 else members, threshold, rounds))
    # Components by the least key; only classes that are copied or linked differ from their own key.
    of = classes.join(links, classes["digest"] == links["node"], "left").withColumn("r", F.coalesce("root", "digest"))
    roots = links.select(F.col("root").alias("q")).distinct()
    linked = of.join(_small(freed(roots, "roots")), F.col("r") == F.col("q"), "left").where(F.col("q").isNotNull() | (F.col("copies") > 1))
    least = linked.groupBy("r").agg(F.min("first").alias("component"))
    special = linked.select("digest", "r").join(least, "r").select(F.col("digest").alias("d"), "component")
    out = sketch.select("key", "n", "digest").join(_small(freed(special, "special")), F.col("digest") == F.col("d"), "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"), F.col("digest").alias("class"))


def keep_one(docs: DataFrame, key: str = "doc_id", **params) -> DataFrame:
    """The rows of ``docs`` with one document of each component, columns unchanged.

    Of a component's rows the one of least key stays, nulls last, then that of the least digest of
    its text. Rows are told apart by a number of their own, so rows that share a key, null or not,
    go or stay each by its text. Documents without words all stay.
    """
    text = params.get("text", "text")
    body = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))
    rows = freed(docs.withColumns({"__row": F.monotonically_increasing_id(), "__body": body}), "rows")
    found = join(rows, key="__row", **params).where(F.col("n_shingles") > 0).select(F.col("__row").alias("__id"), F.col("component_id").alias("__of"))
    found = freed(found, "found")
    crowds = freed(found.groupBy("__of").agg(F.count("*").alias("__n")).where(F.col("__n") > 1).select(F.col("__of").alias("__crowd")), "crowds")
    crowded = found.join(_small(crowds), F.col("__of") == F.col("__crowd"), "left_semi")
    order = F.struct(F.col(key).isNull(), F.col(key), F.col("__body"), F.col("__row"))
    members = rows.select(key, "__body", "__row").join(_small(freed(crowded, "crowded")), F.col("__row") == F.col("__id")).select("__of", "__row", order.alias("__order"))
    members = freed(members, "members")
    stays = members.groupBy("__of").agg(F.min("__order")["__row"].alias("__stays")).select("__stays")
    gone = members.join(_small(freed(stays, "stays")), F.col("__row") == F.col("__stays"), "left_anti").select(F.col("__row").alias("__gone"))
    return rows.join(_small(freed(gone, "gone")), F.col("__row") == F.col("__gone"), "left_anti").drop("__row", "__body")
