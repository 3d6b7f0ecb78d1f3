"""The corpus pipeline: raw documents to token ids in five stages.

Each stage takes the documents that its predecessor kept and returns documents with the same
columns; the last returns what a trainer reads. Between stages the rows are Parquet files in the
shared folder, so a lost executor never costs more than the running stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm import bpe, jaccard, mixing, pii, quality
from tensorloom.llm.scratch import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the production policy rejects go (null and empty texts too)."""
    return quality.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five words at 0.8: one document of each group stays, that of least id."""
    return jaccard.keep_one(docs, k=5, threshold=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data: spans are replaced by their kind; ``n_chars`` follows the text."""
    return pii.redact(docs, length="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document as often as the mix takes it."""
    return mixing.repeat(docs)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-pair ids of every text, with the check that they decode to it."""
    both = bpe.encode(docs.select("doc_id", "lang", "source", "text"), decoded="decoded")
    intact = F.col("decoded") == F.coalesce("text", F.lit(""))
    return both.select("doc_id", "lang", "source", bpe.n_tokens().alias("n_tokens"), "ids", intact.alias("intact"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode_text),
]
#: Neither the order of the mix's draw over near-duplicate survivors nor BPE is expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
