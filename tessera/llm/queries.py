"""The registered queries opN_<name>: operators with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, search, secrets, sharding, toxicity


#: Labelled rows that make up the trusted sample of the quality rules, at most.
TRUSTED = 4000
LLR_THRESHOLD = -0.06


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))


def op3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return search.top_k(docs, docs.where("doc_id % 50 = 0"), k=10)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").where("quality = 1")
    trusted = labels.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED)
    return quality_rules.judge(_table(spark, sf_dir, "documents"), trusted, buckets=1 << 16, threshold=LLR_THRESHOLD)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True))


def digests(decoded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)
    return taken.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 4
    labels = _table(spark, sf_dir, "labels").where(part("doc_id") != 2)
    scored = toxicity.toxicity(_table(spark, sf_dir, "documents"), labels, most=3000, threshold=0.3)
    return scored.select(
        "doc_id", F.coalesce(part("doc_id") == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), "lang_threshold", "flagged",
    )


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=5, percent=75)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"), secrets.RULES)
    count = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long")
    base = F.filter("spans", lambda x: x.kind.isin([r.kind for r in secrets.RULES if r.base]))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"),
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), most=6000)


QUERIES = {f.__name__: f for f in (op1_sharding, op2_line_dedup, op3_search, op4_quality_rules, op5_bpe, op6_mixing, op7_toxicity, op8_near_dedup, op9_secrets, op10_quality_classifier)}
