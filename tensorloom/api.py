"""Functions over whole files: pack, read, convert, revert, assign."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorloom.functions import codecs, predicates
from tensorloom.functions.dtypes import dtype, element_size
from tensorloom.operators import layout, reconcile
from tensorloom.shipping import ship, written
from tensorloom.sources import container, folder
from tensorloom.sources.container import Block, Entry, Signature
from tensorloom.sources.datasource import register


def pack(
    tensors: DataFrame,
    destination: str,
    target_dtype: str | None = None,
    name_order: Sequence[str] | None = None,
    align_bytes: int = layout.ALIGN_BYTES,
    ignore_names: Sequence[str] | None = None,
    ignore_prefixes: Sequence[str] | None = None,
    ignore_suffixes: Sequence[str] | None = None,
    signature: Signature = Signature(),
) -> container.Footer:
    """Write ``tensors(name, dtype, shape, payload[, ord, chunk_idx])`` as one container.

    The layout is planned over index rows only; payload rows are placed by a join on the name. A
    payload may come in chunks of whole elements (``chunk_idx`` from 0). One file's index, a row a
    tensor, comes to the driver, which writes its footer.
    """
    if align_bytes < 0:
        raise ValueError(f"an alignment of {align_bytes} bytes is below zero")
    spark = register(tensors.sparkSession)
    rows = predicates.keep(tensors, ignore_names, ignore_prefixes, ignore_suffixes)
    rows = rows if "ord" in rows.columns else rows.withColumn("ord", F.col("name"))
    chunked = "chunk_idx" in rows.columns
    heads = (rows.where(F.col("chunk_idx") == 0) if chunked else rows).select(F.lit("").alias("path"), "name", "dtype", "shape", "ord")
    # Index rows serve the block table, the footer and the places; they are small and planned once.
    index = layout.index(heads, align_bytes, target_dtype, name_order).persist()
    try:
        return _write(spark, rows, index, chunked, destination, target_dtype, align_bytes, signature)
    finally:
        index.unpersist()


def _write(spark, rows: DataFrame, index: DataFrame, chunked: bool, destination: str, target_dtype: str | None, align_bytes: int, signature: Signature) -> container.Footer:
    """Place and write the payloads of a planned index."""
    blocks = layout.blocks(index, align_bytes)
    found = blocks.orderBy("macroblock").collect()
    if not found:
        raise ValueError("no tensor is left to pack")
    planned = [Block(b["macroblock"], dtype(b["dtype"]).name, b["offset_bytes"], b["length_bytes"], b["length_elems"]) for b in found]
    size = max(b.offset_bytes + b.length_bytes for b in planned)
    if not size:
        raise ValueError("the tensors to pack hold no bytes")
    entries = [Entry(r["name"], tuple(r["shape"]), r["offset"], r["length"], r["macroblock"]) for r in index.orderBy("macroblock", "rank").collect()]
    footer = container.footer_json(planned, entries, align_bytes, signature)
    wanted = F.col("dtype") if target_dtype is None else F.lit(dtype(target_dtype).name)
    cast = rows.withColumn("payload", codecs.cast_payload(F.col("payload"), F.col("dtype"), wanted)) if target_dtype is not None else rows
    # Every place of a duplicated name is written.
    places = layout.located(index, blocks).select("name", "start_byte")
    if chunked:
        before = Window.partitionBy("name").orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, -1)
        within = cast.select("name", "chunk_idx", F.coalesce(F.sum(F.octet_length("payload").cast("bigint")).over(before), F.lit(0)).alias("within"))
        starts = within.join(places, "name").select("name", "chunk_idx", (F.col("start_byte") + F.col("within")).alias("start_byte"))
        pieces = cast.select("name", "chunk_idx", "payload").join(starts, ["name", "chunk_idx"]).select("start_byte", "payload")
    else:
        pieces = cast.select("name", "payload").join(places, "name").select("start_byte", "payload")
    options = {"path": destination, "footer": container.trailer(footer, signature).hex(), "payload_bytes": str(size)}
    pieces.write.format("tensorpack").mode("append").options(**options).save()
    return container.read_footer(destination, signature)


def pack_folder(
    tensors: DataFrame,
    destination: str,
    container_bytes: int = 1 << 30,
    container_tensors: int = 100_000,
    target_dtype: str | None = None,
    align_bytes: int = layout.ALIGN_BYTES,
    signature: Signature = Signature(),
) -> DataFrame:
    """Write ``tensors(name, dtype, shape, payload[, ord])`` as containers of a new or empty folder.

    Tensors are dealt by a hash of the name into as many containers as their bytes and number call
    for, about ``container_bytes`` and ``container_tensors`` each; a larger tensor makes its own larger.
    All are planned together, and each is written by one task with its own footer: the driver sees two
    sums and a row for each block, neither payloads nor index rows. Names have to be unique, payloads whole. :func:`read` takes
    the folder. Gives path, n_tensors and n_bytes of every container; no tensors, no containers.
    """
    if min(container_bytes, container_tensors) < 1:
        raise ValueError("a container has to hold a byte and a tensor at least")
    spark = tensors.sparkSession
    ship(spark)
    # The name settles ties, so that the order of a file is one and the same for index rows and payloads.
    ord = F.struct(F.col("ord").alias("ord"), F.col("name").alias("name")) if "ord" in tensors.columns else F.col("name")
    payload = F.col("payload") if target_dtype is None else codecs.cast_payload(F.col("payload"), F.col("dtype"), F.lit(dtype(target_dtype).name))
    rows = layout.sized(tensors.select("name", "dtype", "shape", ord.alias("ord"), payload.alias("payload")), target_dtype)
    heads = rows.drop("payload")
    total = heads.agg(F.sum(F.col("numel") * element_size(F.col("dtype"))).alias("bytes"), F.count("*").alias("n")).first()
    n = max(1, -(-(total["bytes"] or 0) // container_bytes), -(-total["n"] // container_tensors))
    number = F.lpad(F.pmod(F.xxhash64("name"), F.lit(n)).cast("string"), len(str(n)), "0")
    path = F.concat(F.lit(destination.rstrip("/") + "/part-"), number, F.lit(".pack"))
    index = written(layout.index(heads.withColumn("path", path), align_bytes), "index")
    blocks = layout.blocks(index, align_bytes)
    places = layout.located(index, blocks).select("path", "macroblock", "rank", "name", F.lit(folder.PLACE).alias("kind"), "start_byte", F.lit(None).cast("binary").alias("payload"))
    # Payloads find their file by the name's hash and their block by a table of a row for each type of a file: they are shuffled once.
    numbered = F.broadcast(blocks.select("path", "dtype", "macroblock"))
    payloads = layout.ordered(rows).withColumn("path", path).join(numbered, ["path", "dtype"])
    payloads = payloads.select("path", "macroblock", "rank", "name", F.lit(folder.PAYLOAD).alias("kind"), F.lit(None).cast("bigint").alias("start_byte"), "payload")
    ends = layout.totals(blocks).select("path", "n_blocks", F.col("total_payload_bytes").alias("start_byte"))
    footers = layout.footer_json(index, blocks, signature.prefix, align_bytes).join(ends, "path")
    none = F.lit(None).cast(index.schema["rank"].dataType).alias("rank")
    footers = footers.select("path", F.col("n_blocks").cast("int").alias("macroblock"), none, F.lit("").alias("name"), F.lit(folder.FOOTER).alias("kind"), "start_byte", F.encode("footer", "UTF-8").alias("payload"))
    pieces = places.unionByName(payloads).unionByName(footers)
    unfinished = f"{destination.rstrip('/')}/_unfinished-{uuid.uuid4().hex}"
    try:
        return written(folder.write(pieces, unfinished, signature), "containers")
    finally:
        system, inner = container.file_system(unfinished)
        if system.get_file_info(inner).type.name == "Directory":
            system.delete_dir(inner)


def read(spark: SparkSession, path: str, what: str = "chunks", ignore_names=None, ignore_prefixes=None, ignore_suffixes=None, **options) -> DataFrame:
    """A container's ``chunks``, ``index``, ``blocks`` or ``meta``; ignored names' bytes are not read."""
    name = "tensorpack" if what == "chunks" else f"tensorpack.{what}"
    df = register(spark).read.format(name).options(path=path, **options).load()
    return predicates.keep(df, ignore_names, ignore_prefixes, ignore_suffixes, nulls=False) if what in ("chunks", "index") else df


def tensors(spark: SparkSession, path: str, **options) -> DataFrame:
    """path, name, dtype, shape, payload: tensors as single values, for such as fit one (2 GB)."""
    chunks = read(spark, path, **options)
    grouped = chunks.groupBy("path", "macroblock", "dtype", "name", "shape").agg(F.sort_array(F.collect_list(F.struct("chunk_idx", "payload"))).alias("c"))
    joined = F.aggregate("c", F.lit(b""), lambda a, x: F.concat(a, x["payload"]))
    whole = F.when(F.size("c") == 1, F.get("c", F.lit(0))["payload"]).otherwise(joined)
    return grouped.select("path", "name", "dtype", "shape", whole.alias("payload"))


def assign(spark: SparkSession, path: str, expected: DataFrame, policy: reconcile.Policy = reconcile.Policy(), **ignore) -> tuple[DataFrame, dict]:
    """The stored tensors that a model takes, with target types, and the counts; raises by policy.

    With ``coerce_dtype`` buffers come in the type that the model expects.
    """
    index = read(spark, path, "index").select("name", "dtype", "length")
    status = reconcile.reconcile(index, expected, **ignore)
    counts = reconcile.enforce(status, policy)
    taken = status.where(F.col("status").startswith("assigned_")).select("name", "kind", "expected_dtype")
    rows = read(spark, path, **ignore).join(taken, "name")
    if policy.coerce_dtype:
        target = F.when(F.col("kind") == "buffer", F.col("expected_dtype")).otherwise(F.col("dtype"))
        rows = rows.withColumn("payload", codecs.cast_payload(F.col("payload"), F.col("dtype"), target)).withColumn("dtype", target)
    return rows.drop("expected_dtype"), counts


def default_destination(source: str, target_extension: str) -> str:
    """The source's path with another extension."""
    base, ext = os.path.splitext(source)
    return (base if ext else source) + target_extension


def _same(a: str, b: str) -> bool:
    """Whether two local paths or URIs name one file."""
    plain = lambda p: p.rstrip("/") if "://" in p else os.path.abspath(p)
    return plain(a) == plain(b)


def convert(spark: SparkSession, source: str, destination: str | None = None, target_dtype: str | None = None, **options) -> str:
    """A tensor file (``.safetensors``) or Parquet table of tensors as a container."""
    from tensorloom.sources import safetensors

    destination = destination or default_destination(source.rstrip("/"), ".pack")
    if _same(destination, source):
        raise ValueError(f"{destination} would be written over its own source")
    if source.endswith((".pt", ".pth", ".bin", ".ckpt")):
        raise ValueError("Pickled checkpoints can't be read; convert them to safetensors first.")
    rows = safetensors.read(spark, source) if source.endswith(".safetensors") else spark.read.parquet(source)
    pack(rows, destination, target_dtype=target_dtype, **options)
    return destination


def revert(spark: SparkSession, source: str, destination: str | None = None, **options) -> str:
    """A container as a safetensors file (by extension) or a Parquet table of tensors."""
    from tensorloom.sources import safetensors

    destination = destination or default_destination(source, ".safetensors")
    if _same(destination, source):
        raise ValueError(f"{destination} would be written over its own source")
    rows = tensors(spark, source, **options)
    if destination.endswith(".safetensors"):
        safetensors.write(rows, destination)
    else:
        rows.write.mode("overwrite").parquet(destination)
    return destination
