"""The queries opN: each operator over its whole table, with the digest columns derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm import bpe, hamming, jaccard, licenses, mixing, oracles, pii, quality, secret_scan, sharding, urlfilter
from tensorloom.llm.spans import joined


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _counts(spans: str, kinds: tuple) -> list:
    """The number of spans of each kind, as longs."""
    of = lambda k: F.filter(spans, lambda s: s["kind"] == k)
    return [F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: the base kinds' digest, all spans, their scores, and how many are sure."""
    found = pii.scan(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    sure = F.size(F.filter("spans", lambda s: s["score"] >= pii.LEAST)).cast("long")
    return found.select(
        "doc_id", *_counts("spans", pii.BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        scores.alias("scores"), sure.alias("n_sure"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight shards of near equal bytes."""
    dealt = sharding.shard(_table(spark, sf_dir, "documents"))
    return dealt.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license of every document, with ``source/lang/doc_id.txt`` as its path."""
    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    found = licenses.scan(docs.select("doc_id", path.alias("path"), "text"), keys=("doc_id",))
    return found.withColumn("score", F.coalesce("score", F.lit(0.0)))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every 50th vector, among all vectors."""
    codes = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.top_k(codes, codes.where(F.col("id") % 50 == 0))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; the base kinds' digest and all spans."""
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))
    return found.select("doc_id", *_counts("spans", secret_scan.BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles are 85 % alike."""
    found = jaccard.join(_table(spark, sf_dir, "documents"), k=4, threshold=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of its ids and of the text they decode to."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.encode(docs, decoded="decoded")
    return both.select("doc_id", bpe.n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document, with the base policy's verdict and the production policy's."""
    book = quality.ledger(_table(spark, sf_dir, "documents"))
    base = ~quality.passes("base-1")
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & quality.passes()).alias("kept"), "failures",
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of every policy costs: the ledger of ``op9_quality``, summed by its failure bits."""
    return quality.ablations(quality.ledger(_table(spark, sf_dir, "documents")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


QUERIES = {
    "op1_pii": op1_pii,
    "op2_sharding": op2_sharding,
    "op3_licenses": op3_licenses,
    "op4_urls": op4_urls,
    "op5_top_k": op5_top_k,
    "op6_secrets": op6_secrets,
    "op7_jaccard": op7_jaccard,
    "op8_bpe": op8_bpe,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
}
ORACLES = oracles.SQL
#: Further results of these operators, with their SQL.
REPORTS = {"quality_ablation": quality_ablation}
REPORT_ORACLES = {"quality_ablation": oracles.ABLATION}
