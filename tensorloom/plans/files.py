"""Queries that write a container to the session's shared folder and read it back."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom import api
from tensorloom.functions import codecs, scalars
from tensorloom.functions.dtypes import DTYPES
from tensorloom.shipping import run_dir, ship
from tensorloom.sources import container

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def folder(spark: SparkSession) -> str:
    """A new folder below the application's own."""
    from pyarrow import fs

    path = f"{run_dir(spark)}/packs-{uuid.uuid4().hex}"
    path = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    system.create_dir(inner, recursive=True)
    return path


def _float32_bytes(values: str) -> Column:
    @F.pandas_udf("binary")
    def run(arrays: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else codecs.encode(v, "float32") for v in arrays])

    return run(values)


def payload_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as bytes and vectors as float32: name, dtype, shape, payload."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.length("text") > 0)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    texts = docs.select(
        F.concat_ws(".", F.lit("doc"), "lang", F.col("doc_id").cast("string"), F.lit("text")).alias("name"), F.lit("uint8").alias("dtype"),
        F.array(F.octet_length("text").cast("bigint")).alias("shape"), F.encode("text", "UTF-8").alias("payload"),
    )
    weights = vectors.select(
        F.concat_ws(".", F.lit("emb"), F.col("label").cast("string"), F.col("vec_id").cast("string"), F.lit("weight")).alias("name"), F.lit("float32").alias("dtype"),
        F.array(F.size("embedding").cast("bigint")).alias("shape"), _float32_bytes("embedding").alias("payload"),
    )
    return texts.unionByName(weights)


def _packed_folder(spark: SparkSession, sf_dir: str, **options) -> str:
    path = f"{folder(spark)}/model"
    api.pack_folder(payload_tensors(spark, sf_dir), path, **options)
    return path


@query("SELECT 'doc.' || lang || '.' || doc_id || '.text' AS name, 'uint8' AS dtype, octet_length(encode(text))::BIGINT AS length, md5(text) AS content FROM documents WHERE length(text) > 0")
def container_scan(spark, sf_dir):
    """Whole tensors of one type, by a filter that the scan takes over: no vector's bytes are read."""
    path = _packed_folder(spark, sf_dir)
    rows = api.tensors(spark, path, ignore_prefixes=["emb."])
    return rows.select("name", "dtype", F.get("shape", F.lit(0)).alias("length"), F.md5("payload").alias("content"))


@query(
    "SELECT dtype, count(*)::BIGINT AS n_tensors, sum(n)::BIGINT AS n_elems FROM (SELECT 'uint8' AS dtype, octet_length(encode(text)) AS n FROM documents WHERE length(text) > 0 "
    "UNION ALL SELECT 'float32', len(embedding) FROM embeddings) GROUP BY dtype"
)
def container_index(spark, sf_dir):
    """What containers hold, from their footers alone."""
    index = api.read(spark, _packed_folder(spark, sf_dir), "index")
    return index.groupBy("dtype").agg(F.count("*").alias("n_tensors"), F.sum("length").alias("n_elems"))


@query(
    "SELECT (SELECT count(*) FROM documents WHERE length(text) > 0) + (SELECT count(*) FROM embeddings) AS n, (SELECT count(*) FROM documents WHERE length(text) > 0) + (SELECT count(*) FROM embeddings) AS n_equal"
)
def roundtrip_equal(spark, sf_dir):
    """Source and files joined both ways: every tensor is there with its type, shape and bytes."""
    source = payload_tensors(spark, sf_dir).select("name", F.col("dtype").alias("d"), F.col("shape").alias("s"), F.md5("payload").alias("m"))
    stored = api.tensors(spark, _packed_folder(spark, sf_dir, align_bytes=100)).select("name", "dtype", "shape", F.md5("payload").alias("md5"))
    both = source.join(stored, "name", "full_outer")
    equal = F.col("d").eqNullSafe(F.col("dtype")) & F.col("s").eqNullSafe(F.col("shape")) & F.col("m").eqNullSafe(F.col("md5"))
    return both.agg(F.count("*").alias("n"), F.count_if(equal).alias("n_equal"))


@query("SELECT dtype, (SELECT count(*) FROM embeddings) AS n, (SELECT count(*) FROM embeddings) AS n_close FROM (SELECT unnest(['bfloat16', 'float16']) AS dtype)")
def roundtrip_close(spark, sf_dir):
    """Vectors cast to a narrow type and back: every number is close to its own by that type's tolerance."""
    ship(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("x"))
    parts = []
    for dtype, rtol in (("bfloat16", 2.0**-8), ("float16", 2.0**-11)):
        back = F.pandas_udf(lambda xs, d=dtype: pd.Series([codecs.decode(codecs.encode(x, d), d).astype("float32") for x in xs]), "array<float>")
        excess = F.transform(F.arrays_zip(back("x").alias("b"), F.col("x").alias("a")), lambda p: scalars.close_excess(p["b"], p["a"], 1e-6, rtol))
        parts.append(vectors.select(F.lit(dtype).alias("dtype"), (F.array_max(excess) <= 0).alias("close")))
    return parts[0].unionByName(parts[1]).groupBy("dtype").agg(F.count("*").alias("n"), F.count_if("close").alias("n_close"))


@query(
    "SELECT 'good.pack' AS file, true AS is_valid, NULL AS fault UNION ALL SELECT 'magic.pack', false, 'not signed' UNION ALL SELECT 'short.pack', false, 'less than the end' "
    "UNION ALL SELECT 'length.pack', false, 'begin before the file' UNION ALL SELECT 'format.pack', false, 'no container format' UNION ALL SELECT 'blocks.pack', false, 'lists none' "
    "UNION ALL SELECT 'range.pack', false, 'said to be in block'"
)
def container_validity(spark, sf_dir):
    """Good and faulty files, read permissively; ``good.pack`` is a folder of containers, good if each one is there and valid.

    The tensors are dealt over containers of bounded bytes and number, so neither the driver nor a task holds the whole index.
    """
    home = folder(spark)
    made = api.pack_folder(payload_tensors(spark, sf_dir), f"{home}/good.pack")
    system, inner = container.file_system(home)
    v4 = f'{{"format":"{container.PREFIX}_v4","align_bytes":128,"total_elems":1'
    block = '"macroblocks":[{"dtype":"uint8","offset_bytes":0,"length_bytes":1,"length_elems":1}]'
    faults = {
        "magic": b"\0" * 32,
        "short": b"\0" * 15,
        "length": container.LENGTH.pack(999) + container.MAGIC,
        "format": container.trailer(b'{"format":"other_v9"}'),
        "blocks": container.trailer((v4 + "}").encode()),
        "range": container.trailer((v4 + f',{block},"index":[{{"name":"x","shape":[1],"offset":0,"length":1,"macroblock":99}}]}}').encode()),
    }
    for name, raw in faults.items():
        with system.open_output_stream(f"{inner}/{name}.pack") as f:
            f.write(raw)
    meta = api.read(spark, home, "meta", mode="permissive")
    fault = F.regexp_extract("error", "(not signed|less than the end|begin before the file|no container format|lists none|said to be in block)", 1)
    found = meta.select(F.regexp_extract("path", r"([^/]+\.pack)(?:/[^/]*)?$", 1).alias("file"), "is_valid", F.when(F.col("error").isNotNull(), fault).alias("fault"), "n_tensors")
    is_good = F.col("file") == "good.pack"
    read = found.where(is_good).agg(F.count_if("is_valid").alias("n"), F.coalesce(F.sum("n_tensors"), F.lit(0)).alias("tensors"), F.min("fault").alias("fault"))
    wanted = made.agg(F.count("*").alias("n_made"), F.coalesce(F.sum("n_tensors"), F.lit(0)).alias("tensors_made"))
    whole = (F.col("n") == F.col("n_made")) & (F.col("tensors") == F.col("tensors_made"))
    good = read.crossJoin(wanted).select(F.lit("good.pack").alias("file"), whole.alias("is_valid"), "fault")
    return good.unionByName(found.where(~is_good).drop("n_tensors"))


@query("SELECT d AS dtype, (SELECT count(*) FROM lineitem) AS n, (SELECT count(*) FROM lineitem) AS n_equal FROM (SELECT unnest([" + ", ".join(f"'{d.name}'" for d in DTYPES) + "]) AS d)")
def codec_roundtrip(spark, sf_dir):
    """Numbers that every type can hold, encoded and decoded in each of the 21 types."""
    ship(spark)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_linenumber").cast("int").alias("x"))
    names = [d.name for d in DTYPES]

    def run(batches):
        for pdf in batches:
            for name in names:
                powers = np.array([1, 2, 4, 1, 2, 4, 1])[pdf["x"].to_numpy() % 7]
                x = powers > 1 if name == "bool" else powers
                back = codecs.decode(codecs.encode(x, name), name)
                yield pd.DataFrame({"dtype": [name], "n": [len(x)], "n_equal": [int(np.sum(back == x))]})

    return lines.mapInPandas(run, "dtype string, n bigint, n_equal bigint").groupBy("dtype").agg(F.sum("n").alias("n"), F.sum("n_equal").alias("n_equal"))
