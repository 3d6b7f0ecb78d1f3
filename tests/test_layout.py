"""The windowed layout against a sequential plan, and golden values."""

import random
from math import gcd

import pytest
from pyspark.sql import functions as F

from tensorloom.functions.dtypes import BY_NAME, DTYPES, align_block, align_elems, dtype
from tensorloom.operators import layout
from tensorloom.operators.running import running
from tensorloom.sources import adapters


def sequential(tensors, align, order=None):
    """(blocks, index) by walking the tensors one after the other."""
    size = lambda shape: __import__("math").prod(shape)
    rows = [t for n in order for t in tensors if t[0] == n] if order is not None else sorted(tensors, key=lambda t: (-size(t[2]), t[3]))
    kinds = list(dict.fromkeys(t[1] for t in rows))
    blocks, index, end = [], [], 0
    for b, kind in enumerate(kinds):
        e = BY_NAME[kind].size
        step = align // gcd(align, e) if align else 0
        block = align * e // gcd(align, e) if align else e
        end += -end % block
        at = 0
        for name, _, shape, _ in [t for t in rows if t[1] == kind]:
            at += -at % step if step else 0
            index.append((b, name, at, size(shape)))
            at += size(shape)
        blocks.append((b, kind, end, at * e, at))
        end += at * e
    return blocks, index


def frame(spark, tensors):
    return spark.createDataFrame([("p", *t) for t in tensors], "path string, name string, dtype string, shape array<bigint>, ord bigint")


@pytest.mark.parametrize("align", [0, 1, 3, 100, 128])
def test_layout_equals_sequential(spark, align):
    rng = random.Random(align)
    tensors = [(f"t{i}", rng.choice(DTYPES).name, rng.choice([[], [0], [7], [3, 5], [rng.randrange(1, 500)], [2, 2, 2]]), i) for i in range(60)]
    blocks, index = sequential(tensors, align)
    rows = layout.index(frame(spark, tensors), align)
    assert [tuple(r) for r in rows.orderBy("macroblock", "rank").select("macroblock", "name", "offset", "length").collect()] == index
    got = layout.blocks(rows, align).orderBy("macroblock").select("macroblock", "dtype", "offset_bytes", "length_bytes", "length_elems")
    assert [tuple(r) for r in got.collect()] == blocks
    assert layout.violations(rows, align).count() == 0


def test_explicit_order_keeps_duplicates_and_drops_the_rest(spark):
    tensors = [("a", "int8", [3], 0), ("b", "float32", [2], 1), ("c", "int8", [9], 2)]
    order = ["c", "x", "a", "c"]
    rows = layout.index(frame(spark, tensors), 4, name_order=order)
    assert [tuple(r) for r in rows.orderBy("rank").select("macroblock", "name", "offset", "length").collect()] == [(0, "c", 0, 9), (0, "a", 12, 3), (0, "c", 16, 9)]


def test_several_checkpoints_do_not_mix(spark):
    one = [("a", "int8", [3], 0), ("b", "float32", [2], 1)]
    both = frame(spark, one).unionByName(frame(spark, one).withColumn("path", F.lit("q")))
    totals = layout.totals(layout.blocks(layout.index(both))).orderBy("path").drop("path").collect()
    assert totals[0] == totals[1] and totals[0]["version"] == 4
    single = layout.totals(layout.blocks(layout.index(both, target_dtype="bfloat16"))).first()
    assert single["version"] == 3


def test_golden_blocks(spark):
    t = adapters.tensors(spark, "/root/testdata/sf0.001")
    got = layout.blocks(layout.index(t)).orderBy("macroblock").drop("path").collect()
    assert [tuple(r) for r in got] == [
        (0, "uint8", 0, 667147, 667147, 250), (1, "int32", 667264, 25560, 6390, 3), (2, "int64", 692864, 48000, 6000, 1),
        (3, "float64", 740864, 68320, 8540, 7), (4, "float32", 809216, 128000, 32000, 500),
    ]


def test_refusals(spark):
    with pytest.raises(ValueError, match="negative"):
        layout.index(frame(spark, [("a", "int8", [1], 0)]), -1)
    for bad in ("float4_e2m1fn_x2", "string"):
        with pytest.raises(ValueError):
            dtype(bad)
    assert all(align_elems(128, d.size) * d.size == align_block(128, d.size) for d in DTYPES)
    index = layout.index(frame(spark, [("a", "int8", [1], 0)]))
    with pytest.raises(Exception, match="macroblock 99"):
        layout.located(index.withColumn("macroblock", F.lit(99)), layout.blocks(index)).collect()


def test_running_sums_split_one_key_over_ranges(spark):
    """One key over several tasks, a null key, an empty key and ties."""
    rng = random.Random(3)
    data = [(k, i, rng.randrange(9)) for k, n in (("a", 500), (None, 40), ("b", 1)) for i in range(n)]
    rows = spark.createDataFrame(rng.sample(data, len(data)), "k string, i bigint, x bigint")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running(rows, ["k"], ["i"], before=F.col("x"), pos=F.lit(1))
        assert got.columns == ["k", "i", "x", "before", "pos"]
        want, at = {}, {}
        for k, i, x in data:
            want[k, i] = (x, *at.get(k, (0, 0)))
            at[k] = (at.get(k, (0, 0))[0] + x, i + 1)
        assert {(r[0], r[1]): tuple(r[2:]) for r in got.collect()} == want
        assert running(rows.where("false"), ["k"], ["i"], pos=F.lit(1)).count() == 0
        assert sorted(r[0] for r in running(rows.withColumn("i", F.lit(7)), ["k"], ["i"], pos=F.lit(1)).where("k = 'a'").select("pos").collect()) == list(range(500))
        ranges = rows.where("k = 'a'").repartitionByRange("k", "i").select(F.spark_partition_id().alias("p")).distinct().count()
        assert ranges > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
