"""Metadata listings and load statistics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.functions.scalars import left_justified, zero_padded
from tensorloom.operators.running import running


def block_lines(blocks: DataFrame) -> DataFrame:
    """path, position, line: blocks by byte offset, as ``i: dtype start:end`` with equal digits."""
    whole = Window.partitionBy("path")
    digits = F.length(F.max(F.col("offset_bytes") + F.col("length_bytes")).over(whole).cast("string"))
    rows = blocks.withColumn("digits", digits).withColumn("position", F.row_number().over(whole.orderBy("offset_bytes", "macroblock")) - 1)
    end = F.col("offset_bytes") + F.col("length_bytes")
    line = F.concat(
        F.col("position").cast("string"), F.lit(": "), left_justified(F.col("dtype"), 10), F.lit(" "),
        zero_padded(F.col("offset_bytes"), F.col("digits")), F.lit(":"), zero_padded(end, F.col("digits")),
    )
    return rows.select("path", F.col("position").cast("bigint").alias("position"), line.alias("line"))


def index_lines(index: DataFrame) -> DataFrame:
    """path, position, new_block, line: tensors by (block, offset); ``new_block`` marks a block's first."""
    end = F.col("offset") + F.col("length")
    index = index.withColumn("macroblock", F.coalesce("macroblock", F.lit(0)))
    whole = Window.partitionBy("path")  # blocks: 21 a checkpoint at most
    blocks = index.groupBy("path", "macroblock").agg(F.count("*").alias("held"), F.max(end).alias("most"))
    earlier = F.sum("held").over(whole.orderBy("macroblock").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(
        F.col("path").alias("p"), F.col("macroblock").alias("m"), F.coalesce(earlier, F.lit(0)).alias("first"),
        F.sum("held").over(whole).alias("n"), F.max("most").over(whole).alias("most"),
    )
    rows = running(index, ["path"], ["macroblock", "offset", "name"], position=F.lit(1))
    rows = rows.join(blocks, F.col("path").eqNullSafe(F.col("p")) & (F.col("macroblock") == F.col("m")))
    rows = rows.withColumn("new_block", F.col("position") == F.col("first"))
    digits = F.length(F.col("most").cast("string"))
    line = F.concat(
        zero_padded(F.col("position"), F.length(F.col("n").cast("string"))), F.lit(": "), zero_padded(F.col("offset"), digits), F.lit(":"),
        zero_padded(end, digits), F.lit(" "), F.col("name"), F.lit(" ["), F.array_join(F.transform("shape", lambda x: x.cast("string")), ", "), F.lit("]"),
    )
    return rows.select("path", "position", "new_block", line.alias("line"))


def labelled(key: Column, labels: Mapping[str, str]) -> Column:
    """A dictionary's label; null for keys that it doesn't have."""
    return F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[key]


def load_stats(runs: DataFrame, labels: Mapping[str, str] | None = None) -> DataFrame:
    """Per (model, total_bytes): mean, min and max of both times and rates, size and speed-up, by size.

    ``runs(model, base_time, packed_time, total_bytes)``; rates are in 1024**3 bytes a second. Rows
    without a model, label or size are left out.
    """
    if labels is not None:
        runs = runs.withColumn("model", labelled(F.col("model"), labels))
    runs = runs.where(F.col("model").isNotNull() & F.col("total_bytes").isNotNull())
    for x in ("base", "packed"):
        runs = runs.withColumn(f"{x}_gbps", F.col("total_bytes") / F.col(f"{x}_time") / F.lit(float(1024**3)))
    measures = [f"{x}_{y}" for x in ("base", "packed") for y in ("time", "gbps")]
    grouped = runs.groupBy("model", "total_bytes").agg(*[f(m).alias(f"{m}_{n}") for m in measures for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])
    grouped = grouped.withColumn("total_gb", F.col("total_bytes") / F.lit(float(1024**3)))
    return grouped.withColumn("speedup", F.col("base_time_mean") / F.col("packed_time_mean")).orderBy("total_bytes", "model")
