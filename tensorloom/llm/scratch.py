"""Written intermediate tables in the folder that all executors share.

Long plans are cut by writing Parquet below ``spark.checkpoint.dir`` and reading it back: the
files outlive any executor, so a lost executor costs a reread and never a recomputation that
could deal rows differently. Only where the session names no such folder (tests, notebooks on one
machine) one is made below the warehouse. The tables are removed when the process ends, or by
:func:`tensorloom.shipping.clear` once a result is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.shipping import run_dir, ship

#: Whether shuffle files are removed when a query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: evaluated once, lineage cut."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed(df: DataFrame, name: str) -> DataFrame:
    """As :func:`written`, but the write's shuffle files go at its end.

    Else they stay until the driver collects its garbage, and those of several steps add up on the disk.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        conf.set(CLEANUP, before)


def blank(text: Column) -> Column:
    """A null text as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def for_workers(spark: SparkSession, most_bytes: int = 8 << 20) -> None:
    """Make Python workers ready: the package within reach, batches held to so many bytes.

    Without a bound in bytes a batch is bounded by rows alone, and grows with the texts' length.
    """
    ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(2**31 - 1)).rstrip("b")) > most_bytes:
        spark.conf.set(name, str(most_bytes))
