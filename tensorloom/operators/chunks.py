"""The plan by which a block is copied in chunks, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.dtypes import element_size
from tensorloom.functions.scalars import CHUNK_FLOOR, ceil_div, chunk_bytes, int_div


def chunk_sizes(blocks: DataFrame, floor: int = CHUNK_FLOOR) -> DataFrame:
    """``blocks`` with chunk_elems and n_chunks."""
    size = element_size(F.col("dtype"))
    elems = F.greatest(int_div(chunk_bytes(F.col("length_bytes"), floor), size), F.lit(1).cast("bigint"))
    return blocks.withColumn("chunk_elems", elems).withColumn("n_chunks", ceil_div(F.col("length_elems"), F.col("chunk_elems")))


def chunk_plan(blocks: DataFrame, floor: int = CHUNK_FLOOR, buffers: int = 4) -> DataFrame:
    """path, macroblock, chunk_idx, start_elem, n_elems, slot, waits: one row for each chunk.

    ``slot`` is the ring buffer that the chunk uses; it waits if the buffer was used before.
    """
    ring = max(1, min(buffers, 8))
    rows = chunk_sizes(blocks, floor).where(F.col("n_chunks") > 0).withColumn("chunk_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_chunks") - 1)))
    start = F.col("chunk_idx") * F.col("chunk_elems")
    return rows.select(
        "path", "macroblock", "chunk_idx", start.alias("start_elem"), F.least(F.col("chunk_elems"), F.col("length_elems") - start).alias("n_elems"),
        F.pmod("chunk_idx", F.lit(ring)).cast("int").alias("slot"), (F.col("chunk_idx") >= ring).alias("waits"),
    )
