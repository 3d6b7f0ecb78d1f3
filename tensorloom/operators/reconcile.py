"""Stored tensors against the names that a model expects, and the strictness policy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.predicates import ignored, keep


@dataclass(frozen=True)
class Policy:
    """``strict`` overrides both flags for missing names; it does not lift the error on discarded
    names while a flag is set."""

    strict: bool | None = None
    strict_params: bool = True
    strict_buffers: bool = False
    coerce_dtype: bool = False


def reconcile(stored: DataFrame, expected: DataFrame, ignore_names=None, ignore_prefixes=None, ignore_suffixes=None) -> DataFrame:
    """One row for each name of either side, with its ``status``.

    ``stored(name, dtype, length)``, ``expected(name, kind, dtype)`` with kind param or buffer; a
    name that is both is a param. Status is assigned_param, assigned_buffer, missing_param,
    missing_buffer or discarded; ``dtype_mismatch`` compares the types of assigned names. Ignored
    names appear on neither side.
    """
    rules = (ignore_names, ignore_prefixes, ignore_suffixes)
    s = keep(stored, *rules).select("name", F.col("dtype").alias("stored_dtype"), F.col("length").alias("stored_length"))
    e = expected.filter(~ignored(F.col("name"), *rules)).groupBy("name").agg(
        F.max("kind").alias("kind"), F.max_by("dtype", "kind").alias("expected_dtype")  # 'param' sorts after 'buffer'
    )
    both = s.join(e, "name", "full_outer")
    status = (
        F.when(F.col("kind").isNull(), F.lit("discarded"))
        .when(F.col("stored_dtype").isNull(), F.concat(F.lit("missing_"), F.col("kind")))
        .otherwise(F.concat(F.lit("assigned_"), F.col("kind")))
    )
    differs = F.col("stored_dtype").isNotNull() & F.col("kind").isNotNull() & (F.col("stored_dtype") != F.col("expected_dtype"))
    return both.select("name", "kind", "stored_dtype", "expected_dtype", "stored_length", status.alias("status"), differs.alias("dtype_mismatch"))


def counts(status: DataFrame) -> DataFrame:
    """One row: how many names have each status, buffer mismatches, and assigned or discarded elements."""
    of = lambda s: F.count_if(F.col("status") == s)
    return status.agg(
        of("assigned_param").alias("assigned_params"), of("assigned_buffer").alias("assigned_buffers"), of("missing_param").alias("missing_params"),
        of("missing_buffer").alias("missing_buffers"), of("discarded").alias("discarded"),
        F.count_if(F.col("dtype_mismatch") & (F.col("kind") == "buffer")).alias("buffer_mismatches"),
        F.coalesce(F.sum("stored_length"), F.lit(0)).alias("total_elements"),
    )


def outcome(strict: Column, strict_params: Column, strict_buffers: Column, coerce: Column, c) -> Column:
    """The policy's outcome for counts ``c`` (name to column): 'ok' or the first error's name."""
    any_strict = F.coalesce(strict, F.lit(False)) | strict_params | strict_buffers
    params, buffers = F.coalesce(strict, strict_params) & (c("missing_params") > 0), F.coalesce(strict, strict_buffers) & (c("missing_buffers") > 0)
    return (
        F.when((c("buffer_mismatches") > 0) & ~coerce, F.lit("buffer_dtype_mismatch"))
        .when(any_strict & (c("discarded") > 0), F.lit("discarded"))
        .when(any_strict & params & buffers, F.lit("missing_both"))
        .when(any_strict & params, F.lit("missing_params"))
        .when(any_strict & buffers, F.lit("missing_buffers"))
        .otherwise(F.lit("ok"))
    )


def policy_matrix(status: DataFrame) -> DataFrame:
    """The outcome under every combination of the flags (24 rows)."""
    spark = status.sparkSession
    flags = [(s, p, b, c) for s in (None, False, True) for p in (False, True) for b in (False, True) for c in (False, True)]
    grid = spark.createDataFrame(flags, "strict boolean, strict_params boolean, strict_buffers boolean, coerce_dtype boolean")
    one = counts(status)
    every = grid.crossJoin(F.broadcast(one))  # 24 rows by one row
    return every.select(*grid.columns, outcome(F.col("strict"), F.col("strict_params"), F.col("strict_buffers"), F.col("coerce_dtype"), F.col).alias("outcome"))


def _offenders(result: str) -> Column:
    """The rows at fault for an outcome."""
    if result == "buffer_dtype_mismatch":
        return F.col("dtype_mismatch") & (F.col("kind") == "buffer")
    wanted = {"discarded": "discarded", "missing_both": "missing_", "missing_params": "missing_param", "missing_buffers": "missing_buffer"}[result]
    return F.col("status").startswith(wanted)


def enforce(status: DataFrame, policy: Policy = Policy()) -> dict:
    """The counts, or a ValueError with the policy's :func:`outcome` and the first 20 rows at fault."""
    flag = lambda x: F.lit(x).cast("boolean")
    result = outcome(flag(policy.strict), flag(policy.strict_params), flag(policy.strict_buffers), flag(policy.coerce_dtype), F.col)
    found = counts(status).withColumn("outcome", result).first().asDict()
    refused = found.pop("outcome")
    if refused == "ok":
        return found
    rows = status.where(_offenders(refused)).orderBy("status", "name").limit(20).collect()
    raise ValueError(f"load refused ({refused}): " + "; ".join(f"{r['name']} {r['status']}" for r in rows))
