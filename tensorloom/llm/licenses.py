r"""License scans: sparse TF-IDF cosine to templates, then inheritance from ancestor directories.

The whole text is one run of words, so line breaks and comment signs don't matter. A template is a
notice as it stands in a file's header, or a passage of a license's text (its title, its grant, a
clause that tells it from others). Each template has two anchors, the words that the fewest other
templates have. Wherever an anchor stands, a window of the template's length is laid so that the
anchor has its place in it, and the window's bag of words is compared with the template's by TF-IDF
cosine; what surrounds a notice is not in its window. Windows at ``THRESHOLD`` or more are the
file's notices. The best score (to two decimals) is the file's own license; of equal ones the first
place in the text, then the longest template, then the first name. Texts without anchors cost a
dictionary look-up a word.

Document frequencies come from all documents and all words: words are counted in ``BUCKETS`` buckets
by hash, so the table has a fixed size. Words of one bucket share its count, which can only make a
word count as more common than it is.

A licence file gives its license to its directory. It is one by its name, or because its whole text
is as similar to a template, or because it holds two passages of its license's text. A file without
a license of its own inherits from its nearest ancestor directory that has one, by a join of
directory paths: each directory is expanded to its ancestors once, not each file, and the
directories' answers are joined back to the files. If a directory has several licence files, the one
of the highest score counts, then the least path.

Scale: two passes over the texts without a shuffle (frequencies, scores). The template and frequency
tables are of fixed size. Directories are joined by broadcast as long as their bytes are counted to be
few, else by a salted shuffle, so a directory that holds a third of all files is spread over
``SALTS`` tasks.

Defined results: a null text counts as empty and has no own license; a text of any length is read
whole; a null path is the root directory's file without a name and takes part like any other.
Repeated rows get equal results; an empty table gives an empty one. Of extra columns only ``keys``
are read; one that is named like a result column comes back with ``_key`` at its name's end.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.scratch import for_workers, written

THRESHOLD = 0.6
#: Buckets of the words' document frequencies.
BUCKETS = 1 << 18
#: Bytes of paths that are broadcast at most; beyond, they are joined by a shuffle of so many salts.
BROADCAST_BYTES, SALTS = 64 << 20, 16
#: Words whose bucket a worker remembers.
MEMORY = 200_000
# Public license wording.
#: Notices as they stand in headers.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Passages of the licenses' own texts.
PASSAGES = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This License applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this General Public License."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "This license, the Lesser General Public License, applies to some specially designated software packages"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "\"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
)
#: Words without weight.
STOP = frozenset(("a", "and", "any", "are", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it", "its", "no", "not", "of", "on", "or", "that", "the", "this", "to", "with", "you"))
LICENCE_FILES = r"(?i)^(?:LICEN[CS]E|COPYING|UNLICENSE)(?:[._-].*)?$"
TEMPLATES = NOTICES + PASSAGES
#: A license whose text is another's with one passage more: (the other, its place among the templates, the license).
CLAUSE = ("BSD-2-Clause", [t.startswith("Neither the name") for _, t in TEMPLATES].index(True), "BSD-3-Clause")
RESULTS = ("path", "license", "score", "origin", "notices", "from_dir")
_word = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*").findall


def tokens(text: str) -> list[str]:
    """Lower-cased words with weight, inner dots and hyphens kept."""
    return [w for w in _word(text.lower()) if w not in STOP]


def bucket(word: str) -> int:
    """The word's bucket: the first 18 bits of its MD5 digest."""
    return int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:5], 16) >> 2


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        got = self[word] = bucket(word)
        return got


_buckets = _Buckets()


def anchors() -> list[tuple[int, str, int]]:
    """(template, word, place): the two anchors of each template."""
    held = [tokens(t) for _, t in TEMPLATES]
    spread = Counter(w for words in held for w in set(words))
    out = []
    for i, words in enumerate(held):
        first = {w: words.index(w) for w in words}
        out += [(i, w, first[w]) for w in sorted(first, key=lambda w: (spread[w], first[w]))[:2]]
    return out


class Templates:
    """Unit TF-IDF vectors of the templates, weighted by documents per bucket."""

    def __init__(self, seen: np.ndarray, documents: int):
        self.idf = np.log((documents + 1) / (seen + 1)) + 1
        self.weights, self.lengths = [], []
        for _, text in TEMPLATES:
            words = tokens(text)
            tf = Counter(words)
            norm = math.sqrt(sum((n * self._idf(w)) ** 2 for w, n in tf.items()))
            self.weights.append({w: n * self._idf(w) / norm for w, n in tf.items()})
            self.lengths.append(len(words))
        self.anchors: dict[str, list[tuple[int, int]]] = {}
        for i, w, place in anchors():
            self.anchors.setdefault(w, []).append((i, place))

    def _idf(self, word: str) -> float:
        return float(self.idf[_buckets[word]])

    def cosine(self, tf: Counter, i: int, norm: float) -> float:
        of = self.weights[i]
        return round(sum(n * self._idf(w) * of[w] for w, n in tf.items() if w in of) / norm, 9)

    def _norm(self, tf: Counter) -> float:
        return math.sqrt(sum((n * self._idf(w)) ** 2 for w, n in tf.items()))

    def scan(self, text: str) -> tuple[str | None, float | None, int, bool]:
        """License, score, number of places with a notice, whether the text is a license's own."""
        words = tokens(text)
        places = {(i, p - place) for p, w in enumerate(words) if w in self.anchors for i, place in self.anchors[w]}
        found = []
        for i, start in places:
            tf = Counter(words[max(start, 0) : start + self.lengths[i]])
            score = self.cosine(tf, i, self._norm(tf))
            if score >= THRESHOLD:
                found.append((-round(score, 2), start, -self.lengths[i], TEMPLATES[i][0], i, score))
        if not found:
            return None, None, 0, False
        best = min(found)
        license_, held = best[3], {f[4] for f in found}
        passages = sum(i >= len(NOTICES) and TEMPLATES[i][0] == license_ for i in held)
        if license_ == CLAUSE[0] and CLAUSE[1] in held:
            license_ = CLAUSE[2]
        tf = Counter(words)
        norm = self._norm(tf)
        return license_, best[5], len({f[1] for f in found}), passages >= 2 or any(self.cosine(tf, i, norm) >= THRESHOLD for i in range(len(TEMPLATES)))


def frequencies(files: DataFrame, text: str = "text") -> Templates:
    """The templates weighted by how many of all documents hold each word (``BUCKETS`` sums at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, documents = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                documents += 1
                held = {_buckets[w] for w in set(_word((t or "").lower()))}
                if held:
                    seen[list(held)] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([documents, *seen[at].tolist()], pa.int64())], names=["bucket", "n"])

    counts = files.select(F.col(text).cast("string")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(BUCKETS, np.int64)
    words = counts[counts["bucket"] >= 0]
    seen[words["bucket"].to_numpy(np.int64)] = words["n"].to_numpy(np.int64)
    return Templates(seen, int(counts.loc[counts["bucket"] < 0, "n"].sum()))


def directory(path: Column) -> Column:
    """All before the last slash; the root is empty."""
    return F.regexp_extract(path, r"^(?s:(.*))/[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """A directory and all above it, as (directory, depth)."""
    parts = F.split(path, "/")
    depths = F.sequence(F.lit(0), F.when(path == "", F.lit(0)).otherwise(F.size(parts)))
    return F.transform(depths, lambda d: F.struct(F.array_join(F.slice(parts, 1, d), "/").alias("above"), d.alias("depth")))


def _looked_up(rows: DataFrame, column: str, table: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` joined with a table of unique, non-null keys."""
    size = table.agg(F.coalesce(F.sum(F.octet_length(key)), F.lit(0)), F.count("*")).first()
    if size[0] + 64 * size[1] <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), F.col(column) == F.col(key), how)
    salted = table.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return rows.join(salted, (F.col(column) == F.col(key)) & (F.col("__salt") == F.col("__s")), how).drop("__salt", "__s")


def scan(files: DataFrame, path: str = "path", text: str = "text", keys: tuple = ()) -> DataFrame:
    """``keys``, path, license, score, origin ('own', 'inherited' or null), notices, from_dir."""
    for_workers(files.sparkSession)
    held = files.sparkSession.sparkContext.broadcast(frequencies(files, text))
    own_keys = F.struct(*[files[k].alias(k) for k in keys]) if keys else F.struct(F.lit(0).alias("none"))
    rows = files.select(own_keys.alias("keys"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.col(text).cast("string").alias("text"))
    schema = rows.drop("text").schema.add("own", "string").add("score", "double").add("notices", "long").add("whole", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.scan(t or "") for t in batch.column(2).to_pylist()]
            made = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], names=schema.names)

    own = written(rows.mapInArrow(run, schema).withColumn("dir", directory(F.col("path"))), "own")
    named = F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_FILES)
    givers = own.where(F.col("own").isNotNull() & (named | F.col("whole")))
    givers = givers.groupBy("dir").agg(F.min(F.struct(-F.col("score"), F.col("path"), F.col("own"))).alias("g")).select(F.col("dir").alias("d"), F.col("g.own").alias("given"))
    above = own.where(F.col("own").isNull()).select("dir").distinct().select("dir", F.inline(ancestors(F.col("dir"))))
    nearest = _looked_up(above, "above", written(givers, "givers"), "d", "inner").groupBy(F.col("dir").alias("of")).agg(F.max(F.struct("depth", "above", "given")).alias("n"))
    both = _looked_up(own, "dir", written(nearest, "nearest"), "of", "left")
    inherits = F.col("own").isNull()
    return both.select(
        *[F.col("keys").getField(k).alias(f"{k}_key" if k in RESULTS else k) for k in keys],
        "path", F.coalesce("own", F.col("n.given")).alias("license"), "score",
        F.when(~inherits, F.lit("own")).when(F.col("n.given").isNotNull(), F.lit("inherited")).alias("origin"),
        "notices", F.when(inherits, F.col("n.above")).alias("from_dir"),
    )
