"""The aligned layout of a container, planned as DataFrames over index rows.

``tensors(path, name, dtype, shape, ord)`` is all that a plan needs; payloads never take part. A
tensor's offset is a prefix sum of aligned lengths inside (path, dtype), taken range by range
(``running``), so one checkpoint may hold any number of tensors. Blocks, at most one for each of the
21 types, are folded in an array of their checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.functions.dtypes import DTYPES, align_block, align_elems, dtype
from tensorloom.functions.scalars import align_up, numel, padding
from tensorloom.operators.running import running

ALIGN_BYTES = 128


def _lookup(name: Column, value) -> Column:
    """A property of a dtype name, by a map literal of 21 entries."""
    return F.create_map(*[F.lit(x) for d in DTYPES for x in (d.name, value(d))])[name].cast("bigint")


def sized(tensors: DataFrame, target_dtype: str | None = None) -> DataFrame:
    """``tensors`` with ``numel`` and, where one is given, a single output dtype."""
    if target_dtype is not None:
        tensors = tensors.withColumn("dtype", F.lit(dtype(target_dtype).name))
    return tensors.withColumn("numel", numel(F.col("shape")))


def ordered(tensors: DataFrame, name_order: Sequence[str] | None = None) -> DataFrame:
    """``tensors`` with ``rank``, a struct that sorts them as they are packed.

    By size, largest first, ties in insertion order (``ord``); or by an explicit list, whose unknown
    names fall away, whose duplicates stay, and which drops all tensors that it doesn't name.
    """
    if name_order is None:
        return tensors.withColumn("rank", F.struct((-F.col("numel")).alias("a"), F.col("ord").alias("b")))
    listed = tensors.sparkSession.createDataFrame([(i, n) for i, n in enumerate(name_order)], "place bigint, listed string")
    both = tensors.join(F.broadcast(listed), F.col("name") == F.col("listed"))
    return both.withColumn("rank", F.struct(F.col("place").alias("a"), F.col("ord").alias("b"))).drop("place", "listed")


def positioned(tensors: DataFrame) -> DataFrame:
    """``ordered`` tensors with ``pos`` from 0 inside their checkpoint."""
    return running(tensors, ["path"], ["rank"], pos=F.lit(1))


def groups(tensors: DataFrame) -> DataFrame:
    """path, dtype, macroblock, first_rank, n_tensors: dtypes numbered as they first come in the order."""
    found = tensors.groupBy("path", "dtype").agg(F.min("rank").alias("first_rank"), F.count("*").alias("n_tensors"))
    return found.withColumn("macroblock", (F.row_number().over(Window.partitionBy("path").orderBy("first_rank")) - 1).cast("int"))


def index(tensors: DataFrame, align_bytes: int = ALIGN_BYTES, target_dtype: str | None = None, name_order: Sequence[str] | None = None) -> DataFrame:
    """path, macroblock, dtype, name, shape, offset, length, rank: offsets in elements of the block."""
    if align_bytes < 0:
        raise ValueError("align_bytes must not be negative")
    rows = ordered(sized(tensors, target_dtype), name_order)
    step = align_up(F.col("numel"), _lookup(F.col("dtype"), lambda d: align_elems(align_bytes, d.size)))
    rows = running(rows.select("path", "name", "dtype", "shape", "numel", "rank"), ["path", "dtype"], ["rank"], offset=step)
    numbered = groups(rows).select(F.col("path").alias("p"), F.col("dtype").alias("d"), "macroblock")
    both = rows.join(numbered, (F.col("path") == F.col("p")) & (F.col("dtype") == F.col("d")))
    return both.select("path", "macroblock", "dtype", "name", "shape", "offset", F.col("numel").alias("length"), "rank")


def blocks(index: DataFrame, align_bytes: int = ALIGN_BYTES) -> DataFrame:
    """path, macroblock, dtype, offset_bytes, length_bytes, length_elems, n_tensors."""
    sums = index.groupBy("path", "macroblock", "dtype").agg(F.max(F.col("offset") + F.col("length")).alias("elems"), F.count("*").alias("n"))
    size = _lookup(F.col("dtype"), lambda d: d.size)
    align = _lookup(F.col("dtype"), lambda d: align_block(align_bytes, d.size))
    one = F.struct(F.col("macroblock"), F.col("dtype"), F.col("elems"), F.col("n"), size.alias("size"), align.alias("align"))
    listed = sums.groupBy("path").agg(F.sort_array(F.collect_list(one)).alias("all"))  # 21 entries at most
    entry = "array<struct<macroblock:int,dtype:string,offset_bytes:bigint,length_bytes:bigint,length_elems:bigint,n_tensors:bigint>>"
    kind = f"struct<end:bigint,done:{entry}>"
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.array().alias("done")).cast(kind)

    def place(done: Column, b: Column) -> Column:
        offset = done["end"] + padding(done["end"], b["align"])
        length = b["elems"] * b["size"]
        row = F.array(F.struct(b["macroblock"], b["dtype"], offset, length, b["elems"], b["n"])).cast(entry)
        return F.struct((offset + length).alias("end"), F.concat(done["done"], row).alias("done")).cast(kind)

    return listed.select("path", F.inline(F.aggregate("all", start, place)["done"]))


def totals(blocks: DataFrame) -> DataFrame:
    """path, n_blocks, total_elems, total_payload_bytes, version (3 for a single block, else 4)."""
    found = blocks.groupBy("path").agg(
        F.count("*").alias("n_blocks"), F.sum("length_elems").alias("total_elems"), F.max(F.col("offset_bytes") + F.col("length_bytes")).alias("total_payload_bytes")
    )
    return found.withColumn("version", F.when(F.col("n_blocks") == 1, F.lit(3)).otherwise(F.lit(4)))


def footer_json(index: DataFrame, blocks: DataFrame, prefix: str, align_bytes: int = ALIGN_BYTES) -> DataFrame:
    """path, footer: the compact JSON of each checkpoint's footer, keys and index in file order.

    One checkpoint's index is one value, as the format wants it.
    """
    place = [F.col("macroblock").alias("macroblock"), F.col("offset").alias("at")]
    entry = F.struct(*place, F.struct("name", "shape", "offset", "length").alias("v3"), F.struct("name", "shape", "offset", "length", "macroblock").alias("v4"))
    listed = index.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("macroblock", "rank", entry.alias("e")))).alias("i"))
    block = F.struct("macroblock", F.struct("dtype", "offset_bytes", "length_bytes", "length_elems").alias("b"))
    also = blocks.groupBy("path").agg(F.sort_array(F.collect_list(block)).alias("m"))
    both = listed.join(also, "path").join(totals(blocks), "path")
    v3 = F.struct(
        F.lit(f"{prefix}_v3").alias("format"), F.get("m", F.lit(0))["b"]["dtype"].alias("target_dtype"), F.lit(align_bytes).alias("align_bytes"),
        "total_elems", F.transform("i", lambda x: x["e"]["v3"]).alias("index"),
    )
    v4 = F.struct(
        F.lit(f"{prefix}_v4").alias("format"), F.lit(align_bytes).alias("align_bytes"), "total_payload_bytes", "total_elems",
        F.transform("m", lambda x: x["b"]).alias("macroblocks"), F.transform("i", lambda x: x["e"]["v4"]).alias("index"),
    )
    return both.select("path", F.when(F.col("version") == 3, F.to_json(v3)).otherwise(F.to_json(v4)).alias("footer"))


def located(index: DataFrame, blocks: DataFrame) -> DataFrame:
    """``index`` with each tensor's byte range in the file; entries of unknown blocks are an error.

    The block table is a few rows for each checkpoint; Spark broadcasts it while it is small.
    """
    b = blocks.select(F.col("path").alias("p"), F.col("macroblock").alias("m"), F.col("dtype").alias("block_dtype"), F.col("offset_bytes").alias("block_start"))
    both = index.join(b, (F.col("path") == F.col("p")) & (F.col("macroblock") == F.col("m")), "left").drop("p", "m")
    message = F.concat(F.lit("tensor "), F.col("name"), F.lit(" is said to be in macroblock "), F.col("macroblock").cast("string"), F.lit(", which its file lacks"))
    known = F.when(F.col("block_start").isNull(), F.raise_error(message).cast("bigint")).otherwise(F.col("block_start"))
    size = _lookup(F.col("block_dtype"), lambda d: d.size)
    return both.withColumn("start_byte", known + F.col("offset") * size).withColumn("end_byte", known + (F.col("offset") + F.col("length")) * size).drop("block_start")


def violations(index: DataFrame, align_bytes: int = ALIGN_BYTES) -> DataFrame:
    """path, n_misaligned, first_names: offsets off their alignment, of all rows (ignored names too).

    The rank is tested at once, so Spark's group limit lets three rows a checkpoint leave each task.
    """
    align = _lookup(F.col("dtype"), lambda d: align_elems(align_bytes, d.size))
    off = index.where((align > 0) & (F.pmod("offset", F.greatest(align, F.lit(1))) != 0))
    nth = F.row_number().over(Window.partitionBy("path").orderBy("macroblock", "offset", "name"))
    firsts = off.withColumn("nth", nth).where(F.col("nth") <= 3).groupBy("path")
    firsts = firsts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "name"))), lambda x: x["name"]), ", ").alias("first_names"))
    return off.groupBy("path").agg(F.count("*").alias("n_misaligned")).join(firsts, "path")
