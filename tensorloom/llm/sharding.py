"""Sharding by a k-d tree over metadata, with weighted medians found by distributed histograms.

A point is a group of rows with equal texts (they stay together); its weight is the bytes of all
its rows and its coordinates are metadata: source and language (first bytes, in order) and the text's
size on a log scale. A node is split along its widest dimension, relative to the whole table's range,
at the weighted median, until there are as many leaves as shards, each near the target bytes.

* The median of a node: one job sums the weights of all nodes' points in ``BINS`` bins of the
  chosen dimension, a second sums a hash of the text, the tie-break, of the bin that holds the median
  in ``BINS`` bins. Points are ordered by (bin, bin of the hash), so ties (a source that holds a
  third of all rows) are cut as exactly as any others. At most ``2 * BINS`` sums a node come to the
  driver, whatever the number of rows.
* Groups heavier than ``1 / HEAVY`` of a shard's target would leave shards uneven wherever they
  fall. There are at most ``shards * HEAVY`` of them; they are placed first, heaviest into the
  emptiest shard, and the medians are taken of what the shards have left. A group larger than half
  a target is cut before that into slices of equal numbers of its rows, in order of key (only such a
  group is spread over shards).
* Numbers inside a group or a shard: rows are numbered inside (group or shard, bucket of the key)
  and the buckets' counts are summed, so no task numbers a whole group or shard.

The text is read once; the tables after that hold keys, sizes and coordinates and are written to
the shared folder, so a lost executor can't deal rows differently.

Defined results: a null text has size 1 and checksum 0 like the empty text, and a very long one is a
heavy group; null metadata sorts first; repeated rows are separate rows of the same group, which tie
in all but their slot; a table of one text is cut into slices; an empty table gives an empty one.
Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.scratch import blank, written

SHARDS = 8
BINS = 4096
HEAVY = 32
#: Rows of one numbering bucket, about.
BUCKET_ROWS = 50_000
DIMENSIONS = ("by_source", "by_lang", "by_size")


def _ordered(text: Column) -> Column:
    """The first six bytes of a string as a number, in the strings' byte order."""
    raw = F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8")
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(raw, 1, 6)), 12, "0"), 16, 10).cast("double"), F.lit(0.0))


def _unit(hashed: Column) -> Column:
    """A 64-bit hash as a number in [0, 1)."""
    return F.shiftrightunsigned(hashed, 12).cast("double") / F.lit(float(2**52))


class _Node:
    """Shards ``first`` to ``last`` of the tree and what decides between its halves."""

    def __init__(self, first: int, last: int):
        self.first, self.last, self.middle = first, last, (first + last + 1) // 2
        self.dimension, self.low, self.width = DIMENSIONS[0], 0.0, 1.0
        self.bin, self.sub = BINS, BINS  # points before (bin, sub) go left

    def binned(self) -> Column:
        """The point's bin in the node's dimension."""
        at = F.floor((F.col(self.dimension) - F.lit(self.low)) / F.lit(self.width) * F.lit(float(BINS)))
        return F.least(F.greatest(at, F.lit(0)), F.lit(BINS - 1)).cast("int")


def _sub() -> Column:
    """The point's bin by the hash of its text."""
    return F.floor(F.col("tie") * F.lit(float(BINS))).cast("int")


def _choose(nodes: dict[int, _Node], pick) -> Column:
    """The expression of the node that a point is in."""
    out = None
    for first, node in nodes.items():
        test, value = F.col("node") == F.lit(first), pick(node)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def tree(points: DataFrame, room: list[float], ranges: dict[str, float]) -> DataFrame:
    """``points`` with a column ``shard``, filling the shards' ``room`` of weight evenly.

    ``points`` has the columns of ``DIMENSIONS``, ``tie`` and ``weight``.
    """
    points = points.withColumn("node", F.lit(0))
    nodes = {0: _Node(0, len(room) - 1)}
    while open_ := {k: n for k, n in nodes.items() if n.first < n.last}:
        spans = [f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))]
        for row in points.where(F.col("node").isin(*open_)).groupBy("node").agg(*spans, F.sum("weight").alias("weight")).collect():
            node = open_[row["node"]]
            widths = {d: row[f"high_{d}"] - row[f"low_{d}"] for d in DIMENSIONS}
            node.dimension = max(DIMENSIONS, key=lambda d: (widths[d] / ranges[d] if ranges[d] else 0.0, d))
            node.low, node.width = row[f"low_{node.dimension}"], widths[node.dimension] or 1.0
            left, right = sum(room[node.first : node.middle]), sum(room[node.middle : node.last + 1])
            node.goal = row["weight"] * (left / (left + right) if left + right else 0.5)
        held = points.where(F.col("node").isin(*open_)).withColumn("bin", _choose(open_, _Node.binned))
        sums: dict[int, list] = {}
        for row in held.groupBy("node", "bin").agg(F.sum("weight").alias("w")).collect():
            sums.setdefault(row["node"], []).append((row["bin"], row["w"]))
        for first, found in sums.items():
            node, total = open_[first], 0.0
            for at, w in sorted(found):
                node.bin = at
                if total + w >= node.goal:
                    break
                total += w
            else:
                total -= w  # rounding: the last bin holds the median
            node.rest = node.goal - total
        ties: dict[int, list] = {}
        fine = held.where(F.col("bin") == _choose(open_, lambda n: F.lit(n.bin))).groupBy("node", _sub().alias("sub"))
        for row in fine.agg(F.sum("weight").alias("w")).collect():
            ties.setdefault(row["node"], []).append((row["sub"], row["w"]))
        for first, found in ties.items():
            node, total = open_[first], 0.0
            for at, w in sorted(found):
                node.sub = at
                if total + w / 2 > node.rest:
                    break
                total, node.sub = total + w, at + 1
        left = lambda n: (n.binned() < n.bin) | ((n.binned() == n.bin) & (_sub() < n.sub))
        points = points.withColumn("node", F.coalesce(_choose(open_, lambda n: F.when(left(n), n.first).otherwise(n.middle)), F.col("node")))
        for node in open_.values():
            nodes[node.middle] = _Node(node.middle, node.last)
            nodes[node.first] = _Node(node.first, node.middle - 1)
    return points.withColumnRenamed("node", "shard")


def _place(heavy: list, shards: int, target: float) -> tuple[list[tuple], list[float]]:
    """(group, rows, slice, slices, shard) of the heavy groups, and the room left in each shard."""
    pieces = []
    for group, weight, rows in heavy:
        n = min(64 * shards, rows, 8 * int(-(-weight // (target / 2)))) if weight > target / 2 else 1
        start = [-(-i * rows // n) for i in range(n + 1)]  # row number k is in slice k * n // rows
        pieces += [(weight / rows * (start[i + 1] - start[i]), group, rows, i, n) for i in range(n)]
    used, out = [0.0] * shards, []
    for weight, group, rows, i, n in sorted(pieces, key=lambda p: (-p[0], p[1], p[3])):
        at = min(range(shards), key=lambda s: (used[s], s))
        used[at] += weight
        out.append((group, rows, i, n, at))
    return out, [max(0.0, target - u) for u in used]


def numbered(rows: DataFrame, within: str, buckets: int) -> DataFrame:
    """``rows`` with ``number``: from 0 and without a gap inside each value of ``within``.

    In order of a hash of the key, then key, size and checksum; ``buckets`` of the hash keep tasks small.
    """
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.col("key").cast("string"), F.col("size")), F.lit(buckets)).cast("int"))
    inside = Window.partitionBy(within, "bucket").orderBy("key", "size", "text_crc32")
    rows = written(rows.withColumn("place", F.row_number().over(inside) - 1), "numbered")
    counts = rows.groupBy(within, "bucket").agg(F.count("*").alias("in_bucket"))
    before = Window.partitionBy(within).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(within).alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("start"))
    both = rows.join(starts, (F.col(within) == F.col("s")) & (F.col("bucket") == F.col("b")))
    return both.withColumn("number", (F.col("start") + F.col("place")).cast("long")).drop("s", "b", "start", "place", "bucket")


def shard(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", shards: int = SHARDS
) -> DataFrame:
    """Key, size, text_crc32, shard, slot: one row per row of ``docs``."""
    spark = docs.sparkSession
    raw = F.encode(blank(F.col(text)), "UTF-8")
    rows = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(blank(F.col(text))) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(blank(F.col(text))).alias("group"),
        _ordered(F.col(source)).alias("by_source"),
        _ordered(F.col(lang)).alias("by_lang"),
    )
    rows = written(rows, "rows")
    groups = rows.groupBy("group").agg(
        F.min("by_source").alias("by_source"), F.min("by_lang").alias("by_lang"), F.max("size").alias("size"),
        F.sum("size").cast("double").alias("weight"), F.count("*").alias("n"),
    )
    groups = groups.withColumn("by_size", F.log2(F.col("size").cast("double"))).withColumn("tie", _unit(F.xxhash64("group")))
    groups = written(groups, "groups")
    every = groups.agg(
        F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        *[F.coalesce(F.max(d) - F.min(d), F.lit(0.0)).alias(d) for d in DIMENSIONS],
    ).first()
    target = every["weight"] / shards
    # Heavy by bytes, or by rows: neither kind can have more than shards * HEAVY groups.
    is_heavy = (F.col("weight") > target / HEAVY) | (F.col("n") > max(1.0, every["n"] / (shards * HEAVY)))
    heavy = [(r["group"], r["weight"], r["n"]) for r in groups.where(is_heavy).select("group", "weight", "n").collect()]
    placed, room = _place(heavy, shards, target)
    light = tree(groups.where(~is_heavy), room, {d: every[d] for d in DIMENSIONS}).select("group", F.col("shard").cast("int").alias("shard"))
    whole = spark.createDataFrame([(g, at) for g, _, _, n, at in placed if n == 1], "group long, shard int")
    cut = spark.createDataFrame(sorted({(g, rows_, n) for g, rows_, _, n, _ in placed if n > 1}), "h long, of long, slices long")
    slices = spark.createDataFrame([(g, i, at) for g, _, i, n, at in placed if n > 1], "g long, slice long, shard int")
    columns = ("key", "size", "text_crc32", "shard")
    marked = rows.join(F.broadcast(cut), F.col("group") == F.col("h"), "left").select("key", "size", "text_crc32", "group", "of", "slices")
    buckets = max(1, every["n"] // BUCKET_ROWS)
    one = marked.where(F.col("slices").isNull()).join(light.unionByName(whole), "group").select(*columns)
    if any(p[3] > 1 for p in placed):
        many = numbered(marked.where(F.col("slices").isNotNull()), "group", buckets)
        many = many.withColumn("slice", F.expr("number * slices div of"))
        many = many.join(F.broadcast(slices), (F.col("group") == F.col("g")) & (many["slice"] == slices["slice"]))
        one = one.unionByName(many.select(*columns))
    out = numbered(one, "shard", buckets)
    return out.select(F.col("key").alias(key), "size", "text_crc32", "shard", F.col("number").alias("slot"))
