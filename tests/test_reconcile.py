"""The strictness policy's truth table, and names."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from tensorloom.functions import predicates, scalars
from tensorloom.operators import reconcile
from tensorloom.operators.reconcile import Policy


def verdict(strict, params, buffers, coerce, c):
    """The policy as plain steps."""
    if c["buffer_mismatches"] and not coerce:
        return "buffer_dtype_mismatch"
    if strict or params or buffers:
        if c["discarded"]:
            return "discarded"
        p = c["missing_params"] and (params if strict is None else strict)
        b = c["missing_buffers"] and (buffers if strict is None else strict)
        return "missing_both" if p and b else "missing_params" if p else "missing_buffers" if b else "ok"
    return "ok"


@pytest.mark.parametrize(("mismatch", "discarded", "params", "buffers"), list(product([0, 1], repeat=4)))
def test_truth_table(spark, mismatch, discarded, params, buffers):
    stored = [("p", "int8", 1), ("b", "int16" if mismatch else "int8", 2)] + [("extra", "int8", 4)] * discarded
    want = [("p", "param", "int8"), ("b", "buffer", "int8")] + [("mp", "param", "int8")] * params + [("mb", "buffer", "int8")] * buffers
    s, e = spark.createDataFrame(stored, "name string, dtype string, length bigint"), spark.createDataFrame(want, "name string, kind string, dtype string")
    status = reconcile.reconcile(s, e).cache()
    c = reconcile.counts(status).first().asDict()
    assert c["total_elements"] == 3 + 4 * discarded
    for r in reconcile.policy_matrix(status).collect():
        flags = (r["strict"], r["strict_params"], r["strict_buffers"], r["coerce_dtype"])
        assert r["outcome"] == verdict(*flags, c), flags
    expected = verdict(None, True, False, False, c)
    if expected == "ok":
        reconcile.enforce(status, Policy())
    else:
        with pytest.raises(ValueError):
            reconcile.enforce(status, Policy())


def test_ignored_names_are_never_missing_or_discarded(spark):
    s = spark.createDataFrame([("a.x", "int8", 1), ("rope.y", "int8", 1)], "name string, dtype string, length bigint")
    e = spark.createDataFrame([("a.x", "buffer", "int8"), ("a.x", "param", "int16"), ("z.bias", "param", "int8")], "name string, kind string, dtype string")
    got = {r["name"]: r["status"] for r in reconcile.reconcile(s, e, None, ["rope"], [".bias"]).collect()}
    assert got == {"a.x": "assigned_param"}


def test_predicates(spark):
    df = spark.createDataFrame([("a",), ("A",), ("ab",), ("ba",), (None,)], "name string")
    names = lambda *rules: [r["name"] for r in predicates.keep(df, *rules).collect()]
    assert names(["a"]) == ["A", "ab", "ba", None] and names(None, ["a"]) == ["A", "ba", None] and names(None, None, ["a"]) == ["A", "ab", None] and len(names()) == 5
    assert predicates.resolved([], ["x"]) == ["x"] and predicates.resolved(["y"], ["x"]) == ["y"] and predicates.resolved(None, None) is None


def human(n):
    for limit, unit in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        if n > limit:
            return f"{n / limit:.2f}{unit}"
    return f"{n}"


def test_formats(spark):
    numbers = [0, 999, 1000, 1001, 1005, 1015, 1125, 1135, 999_995, 10**6, 1_005_000, 2_675_000, 10**9, 10**9 + 1, 123_456_789_012, 7 * 10**15]
    df = spark.createDataFrame([(n, float(n)) for n in numbers], "n bigint, s double")
    assert [r[0] for r in df.select(scalars.human_elements(F.col("n"))).collect()] == [human(n) for n in numbers]
    seconds = [0.0, 5e-10, 1e-6, 0.00123456, 0.5, 1.005, 59.999, 60.0, 3599.5, 3600.0, 86399.4]
    plain = ["0.00ns", "0.50ns", "1.00µs", "1.23ms", "500.00ms", f"{1.005:.2f}s", "60.00s", "1m0s", "59m60s", "1h0m0s", "23h59m59s"]
    got = spark.createDataFrame([(s,) for s in seconds], "s double").select(scalars.human_duration(F.col("s"))).collect()
    assert [r[0] for r in got] == plain
    paths = spark.createDataFrame([("a/b.c/d.tar.gz", "x.y.z"), ("a/.hid", "x"), ("a.b/c", "")], "p string, n string")
    got = paths.select(scalars.extension(F.col("p")), scalars.last_segment(F.col("p")), scalars.slashes(F.col("p")), scalars.parent(F.col("n")), scalars.leaf(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(".gz", "d.tar.gz", 2, "x.y", "z"), ("", ".hid", 1, "", "x"), ("", "c", 1, "", "")]
    raw = spark.createDataFrame([((2**64 - 2).to_bytes(8, "little"),)], "b binary").select(scalars.u64_le(F.col("b"))).first()[0]
    assert int(raw) == 2**64 - 2
