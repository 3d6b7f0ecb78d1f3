"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of 64 bits is cut into ``SEGMENTS`` segments of 16. An index holds, for each segment, the
codes in order of the segment's value. A query looks up all values at distance 0, then 1, and so on
from its own, one segment after the other, and verifies what it finds. A code that was not found
after all segments were searched to radius ``s - 1`` and the first ``j + 1`` of them to ``s`` differs
by more than ``SEGMENTS * s + j`` bits, so the search ends, exactly, when the k-th verified distance
is no larger than that.

Scale: rows are dealt by a hash of their id and place into index blocks, one task each, whatever
values or ids they have: a vector (or an id) that a third of all rows share is spread evenly, and
inside a block equal codes are one entry. Blocks hold ``BLOCK_ROWS`` codes at least and
``MOST_BLOCK_ROWS`` at most (about 60 MB with their index), as there are cores for them; a search
costs little more in a large block, so large tables get large ones. Queries go to the blocks by
broadcast, ``QUERY_ROWS`` at a time (17 bytes each; further ones in further rounds).

Before that, every query is searched in one block's worth of rows, with the queries dealt over the
tasks. The distance of its k-th row there bounds that of its k-th row in all, so the blocks search no
further than it and return only rows within it: most blocks return nothing for most queries. The k
best of what is returned are kept, which is exact.

Ties are broken by the smaller id. Defined results: a row without a 64-dimensional vector has no
code, so it is neither a query nor a result; null components count as not positive. Repeated rows
are results of their own. A query finds itself. With fewer than k codes all of them are results.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.scratch import for_workers, written

BITS, SEGMENTS = 64, 4
BLOCK_ROWS, MOST_BLOCK_ROWS = 32_768, 1 << 20
QUERY_ROWS = 500_000
#: Queries whose results are one Arrow batch.
BATCH_QUERIES = 2048
K = 10


def sign_code(vector: Column) -> Column:
    """The 64 signs of a vector as a long (first component in the highest bit), or null."""
    bit = lambda x: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
    code = F.aggregate(vector, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(bit(x)))
    return F.when(F.size(vector) == BITS, code)


@lru_cache(None)
def _flips(radius: int) -> np.ndarray:
    """All 16-bit masks of so many bits."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(16), radius)], np.uint16)


class Index:
    """The distinct codes of one block, by segment."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order, self.starts = [], []
        for s in range(SEGMENTS):
            part = self.segment(codes, s)
            order = np.argsort(part, kind="stable")
            self.order.append(order)
            self.starts.append(np.searchsorted(part[order], np.arange(65537)))

    @staticmethod
    def segment(codes, s: int):
        return ((codes >> np.uint64(16 * s)) & np.uint64(0xFFFF)).astype(np.int64)

    def search(self, query: np.uint64, counts: np.ndarray, k: int, most: int = BITS) -> tuple[np.ndarray, np.ndarray]:
        """Places of codes and their distances that surely hold the k nearest rows with all ties.

        ``counts`` says how many rows each code stands for. Nothing beyond distance ``most`` is asked for.
        """
        seen = np.zeros(len(self.codes), bool)
        rows = np.zeros(BITS + 1, np.int64)  # verified rows by distance
        found, distances = [], []
        for radius in range(17):
            for s in range(SEGMENTS):
                probes = int(self.segment(query, s)) ^ _flips(radius).astype(np.int64)
                low, high = self.starts[s][probes], self.starts[s][probes + 1]
                filled = high > low
                low, n = low[filled], (high - low)[filled]
                if len(n):
                    places = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    at = self.order[s][places]
                    at = at[~seen[at]]
                    if len(at):
                        seen[at] = True
                        d = np.bitwise_count(self.codes[at] ^ query).astype(np.int64)
                        found.append(at)
                        distances.append(d)
                        rows += np.bincount(d, weights=counts[at], minlength=BITS + 1).astype(np.int64)
                covered = SEGMENTS * radius + s
                if covered >= most or rows[: covered + 1].sum() >= k:
                    last = min(most, int(np.searchsorted(np.cumsum(rows), k)))
                    return self._within(found, distances, last)
        return self._within(found, distances, most)

    @staticmethod
    def _within(found: list, distances: list, last: int) -> tuple[np.ndarray, np.ndarray]:
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at, d = np.concatenate(found), np.concatenate(distances)
        return at[d <= last], d[d <= last]


class Block:
    """The rows of one block, sorted by code and id, with the index of their codes."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        order = np.lexsort((ids, codes))
        self.ids = ids[order]
        distinct, self.first, self.counts = np.unique(codes[order], return_index=True, return_counts=True)
        self.index = Index(distinct)

    def nearest(self, code: np.uint64, k: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest rows within ``most``, in order of distance and id."""
        at, d = self.index.search(code, self.counts, k, most)
        # Of a code's rows only the k smallest ids can be results.
        n = np.minimum(self.counts[at], k)
        places = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(at) else at
        ids, far = self.ids[places], np.repeat(d, n)
        best = np.lexsort((ids, far))[:k]
        return ids[best], far[best]


def _arrays(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and codes of all batches."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)) for b in batches]
    return tuple(np.concatenate([h[i] for h in held]) if held else np.empty(0, t) for i, t in enumerate((np.int64, np.uint64)))


def _bounding(held: Broadcast, k: int):
    """The function that gives queries (id, code) their k-th distance in a sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = None
        for batch in batches:
            sample = sample or Block(*held.value)
            far = [sample.nearest(c, k, BITS)[1] for c in batch.column(1).to_numpy().view(np.uint64)]
            most = [int(d[-1]) if len(d) == k else BITS for d in far]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(most, pa.int32())], names=["id", "code", "most"])

    return run


def _searching(held: Broadcast, k: int):
    """The function that searches one block for the queries of a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, codes = _arrays(batches)
        if not len(ids):
            return
        block = Block(ids, codes)
        queries, query_codes, most = held.value
        for at in range(0, len(queries), BATCH_QUERIES):
            found = [block.nearest(c, k, m) for c, m in zip(query_codes[at : at + BATCH_QUERIES], most[at : at + BATCH_QUERIES].tolist(), strict=True)]
            of = np.repeat(queries[at : at + BATCH_QUERIES], [len(f[0]) for f in found])
            columns = [of, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "id", "distance"])

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), id, distance, for ``rows(id, code)`` and ``queries(id, code)``."""
    spark = rows.sparkSession
    for_workers(spark)
    whole = lambda df: df.where(F.col("id").isNotNull() & F.col("code").isNotNull()).select(F.col("id").cast("long"), F.col("code").cast("long"))
    # Rows of one id are told apart by their place, so they too are dealt over all blocks.
    rows = written(whole(rows).withColumn("at", F.pmod(F.monotonically_increasing_id(), F.lit(4096))), "codes")
    queries = written(whole(queries).distinct(), "queries")
    n, n_queries = rows.count(), queries.count()
    blocks = max(1, -(-n // MOST_BLOCK_ROWS), min(-(-n // BLOCK_ROWS), 4 * spark.sparkContext.defaultParallelism))
    rounds = max(1, -(-n_queries // QUERY_ROWS))
    dealt = rows.repartition(blocks, "id", "at").select("id", "code")
    sample = rows.where(F.pmod(F.xxhash64("id", "at"), F.lit(blocks)) == 0).select("id", "code").toPandas()
    held = spark.sparkContext.broadcast((sample["id"].to_numpy(np.int64), sample["code"].to_numpy(np.int64).view(np.uint64)))
    tasks = max(1, min(-(-n_queries // BATCH_QUERIES), 4096))
    bounded = written(queries.repartition(tasks, "id").mapInArrow(_bounding(held, k), "id long, code long, most int"), "bounded")
    parts = []
    for r in range(rounds):
        part = bounded.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(rounds)) == r).toPandas()
        held = spark.sparkContext.broadcast((part["id"].to_numpy(np.int64), part["code"].to_numpy(np.int64).view(np.uint64), part["most"].to_numpy(np.int32)))
        parts.append(dealt.mapInArrow(_searching(held, k), "query_id long, id long, distance int"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    nearest = Window.partitionBy("query_id").orderBy("distance", "id")
    return every.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
