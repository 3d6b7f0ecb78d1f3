"""Benchmark runs in CSV files: an append sink that writes a header each time, and its scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "model string, base_time double, packed_time double, total_bytes bigint"


def append(runs: DataFrame, path: str) -> None:
    """Add runs to a folder of CSV files."""
    runs.select("model", "base_time", "packed_time", "total_bytes").write.mode("append").option("header", True).csv(path)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All runs; headers that repeat inside a file are dropped (their numbers don't parse)."""
    df = spark.read.schema(SCHEMA).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return df.where(F.col("total_bytes").isNotNull())
