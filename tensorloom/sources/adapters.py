"""Parquet tables as checkpoints: every row value or column becomes a named tensor.

The catalogue has no payloads. Ragged values (texts, vectors, pages) are one tensor a row; a numeric
column is one tensor whose length is the table's row count, which Spark takes from a partial count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numeric columns that are tensors of their own: table, column, dtype.
COLUMNS = (
    ("lineitem", "l_orderkey", "int64"),
    ("lineitem", "l_linenumber", "int32"),
    ("lineitem", "l_quantity", "float64"),
    ("orders", "o_totalprice", "float64"),
    ("customer", "c_nationkey", "int32"),
    ("part", "p_size", "int32"),
)


def _rows(df: DataFrame, name: Column, dtype: str, length: Column) -> DataFrame:
    return df.select(name.alias("name"), F.lit(dtype).alias("dtype"), F.array(length.cast("bigint")).alias("shape"))


def _dotted(*parts) -> Column:
    return F.concat_ws(".", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def tensors(spark: SparkSession, sf_dir: str, path: str = "checkpoint") -> DataFrame:
    """path, name, dtype, shape, ord: the whole directory as one mixed-dtype checkpoint.

    The tables have no insertion order, so ties of size are broken by name: ``ord`` is the name's
    own text, compared by bytes.
    """
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    c = lambda name: F.col(name).cast("string")
    parts = [
        _rows(t("embeddings"), _dotted("emb", c("label"), c("vec_id"), "weight"), "float32", F.size("embedding")),
        _rows(t("documents"), _dotted("doc", F.col("lang"), c("doc_id"), "text"), "uint8", F.octet_length("text")),
        _rows(t("pages"), _dotted("page", c("page_id"), "html"), "uint8", F.octet_length("html")),
    ]
    for table, column, dtype in COLUMNS:
        parts.append(_rows(t(table).agg(F.count("*").alias("n")), F.lit(f"{table}.{column}"), dtype, F.col("n")))
    parts.append(_rows(t("events").groupBy("event_type").agg(F.count("*").alias("n")), _dotted("event", F.col("event_type"), "value"), "float64", F.col("n")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # A string tie-breaker sorts as well as a number, and needs no numbering over the whole index.
    return every.select(F.lit(path).alias("path"), "name", "dtype", "shape", F.col("name").alias("ord"))


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, kind, dtype: what a model over the labelled documents would expect.

    Parameters are the texts of documents with a label and, so that some are missing, of ids beyond
    them; buffers are the event values, of which some types differ and one does not exist.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").distinct()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    name = lambda i: _dotted("doc", F.col("lang"), i.cast("string"), "text")
    held = docs.join(labels, "doc_id")
    params = held.select(name(F.col("doc_id")).alias("name"), F.lit("param").alias("kind"), F.lit("uint8").alias("dtype"))
    beyond = held.where(F.col("doc_id") % 7 == 0).select(name(F.col("doc_id") + 1_000_000_000).alias("name"), F.lit("param").alias("kind"), F.lit("uint8").alias("dtype"))
    types = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct()
    buffers = types.select(
        _dotted("event", F.col("event_type"), "value").alias("name"), F.lit("buffer").alias("kind"),
        F.when(F.col("event_type") < "m", "float64").otherwise("float32").alias("dtype"),
    )
    none = spark.createDataFrame([("event.none.value", "buffer", "float64")], "name string, kind string, dtype string")
    return params.unionByName(beyond).unionByName(buffers).unionByName(none)
