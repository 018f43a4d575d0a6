"""From raw documents to token ids: five stages, each an operator of tessera.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. ``run`` applies them to the table documents, each on what the
stage before has written.

1. quality: documents that the hierarchical quality classifier rejects go.
2. lines: later occurrences of repeated three-line windows go from the texts; a document
   stays in the table even if all of its lines are gone, and n_chars follows the text.
3. near_duplicates: of each group of near-duplicates the document with the smallest id stays.
4. mix: each document as often as the mix to target weights takes it.
5. tokens: every document is encoded and decoded again; ids and bytes as digests.

Stages but the last return the columns of documents and no others; further columns of the
input are left behind. Empty tables stay empty, with their columns. Repeated rows and rows
with one id are separate documents to quality, lines, mix and tokens. In near_duplicates an
id that isn't kept goes with all of its rows, and one that is kept keeps all of them; rows
with a null id stay. A null text counts as empty: it is judged by its host and path, has no
lines and no near-duplicates, and is mixed like the others of its source, to which it adds no
words; a source without any word is taken 0 times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, line_dedup, mixing, near_dedup, quality_classifier
from tessera.llm._shared import BROADCAST_ROWS, stored
from tessera.llm.queries import digests

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality_classifier.classify(docs, labels, most=6000, keep=COLUMNS)
    return judged.where("kept").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(docs, columns=["lang", "source", "n_chars"])
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars"))
    return cut.select("doc_id", "text", "row.lang", "row.source", n_chars.cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = near_dedup.near_duplicates(docs.select("doc_id", "text"), shingle=5, percent=75)
    gone = stored(judged.where(~F.col("kept")).select("doc_id").distinct())
    few = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs.select(*COLUMNS), weights=(5, 2, 1), most=3)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]

#: Classifier, hash order and tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs) if i < len(STAGES) - 1 else docs
    return docs
