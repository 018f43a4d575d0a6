"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio, all in Spark SQL expressions.

Each one- and two-word n-gram falls into one of `buckets` by its hash. Two multinomials
over the buckets are counted: of trusted documents (a bounded sample of those labelled
good) and of the whole corpus. A document's score is the mean over its n-grams of
log((c + m) / (e + m)), where c is the trusted sample's count of the bucket, e the count
expected of the sample if it were drawn from the corpus, and m pseudo-counts that hold
buckets with little evidence near 0; in ten-thousandths, as integers: sums don't depend on the
order of addition, and a document falls on the same side of the threshold in every run.

Defined results: a null text has no words; a text without words has score 0 and fails the
base rules; without trusted documents every ratio is that of the smoothed counts; equal
rows are judged one by one; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import WORD, words

SCALE = 10_000


def _pairs(w: Column) -> Column:
    """Hashes of two consecutive words."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.xxhash64(a, b))


def _ngrams(w: Column, pairs: Column) -> Column:
    return F.concat(F.transform(w, lambda x: F.xxhash64(x)), pairs)


def ratios(docs: DataFrame, trusted: DataFrame, buckets: int, smooth: float) -> list[int]:
    """The weight of each bucket. docs: doc_id, text; trusted: doc_id, a bounded number of rows.

    Both counts are one pass over the corpus with partial sums for each bucket in every
    task; the driver gets `buckets` rows.
    """
    grams = docs.withColumn("w", words(F.col("text"))).withColumn("pairs", _pairs(F.col("w")))
    marked = grams.join(F.broadcast(trusted.select(F.col("doc_id").alias("_trusted")).distinct()), F.col("doc_id") == F.col("_trusted"), "left")
    each = marked.select(F.col("_trusted").isNotNull().alias("good"), F.explode(_ngrams(F.col("w"), F.col("pairs"))).alias("gram"))
    counts = each.groupBy(F.pmod(F.col("gram"), F.lit(buckets)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("all"), F.count_if("good").alias("good"))
    good, every = [0] * buckets, [0] * buckets
    for r in counts.collect():
        good[r["bucket"]], every[r["bucket"]] = r["good"], r["all"]
    share = sum(good) / max(1, sum(every))
    return [round(SCALE * math.log((g + smooth) / (e * share + smooth))) for g, e in zip(good, every, strict=True)]


def base_rules(df: DataFrame) -> DataFrame:
    """df (text, w, pairs) with the base counts. Columns in between are named, so that each array is made once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    df = df.withColumn("n_words", F.size("w").cast("long")).withColumn("lines", lines)
    df = df.withColumn("word_chars", F.length(F.array_join("w", "")).cast("long"))
    df = df.withColumn("n_symbols", F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    # Three-word windows, sorted by hash with their places: equal ones stand side by side.
    n = F.greatest(F.col("n_words").cast("int") - 2, F.lit(0))
    df = df.withColumn("triples", F.zip_with(F.slice("pairs", F.lit(1), n), F.slice("w", F.lit(3), n), lambda p, c: F.xxhash64(p, c)))
    df = df.withColumn("triples", F.when(F.size(F.array_distinct("triples")) < F.size("triples"), F.col("triples")))
    df = df.withColumn("placed", F.sort_array(F.transform("triples", lambda x, i: F.struct(x.alias("h"), i.alias("p")))))
    n = F.size("placed")
    df = df.withColumn("next", F.zip_with("placed", F.slice("placed", F.lit(2), n), lambda a, b: F.coalesce(a.h == b.h, F.lit(False))))
    df = df.withColumn("prev", F.concat(F.array(F.lit(False)), F.col("next")))
    repeated = F.zip_with("placed", F.zip_with("next", F.slice("prev", F.lit(1), F.size("next")), lambda a, b: a | b), lambda x, r: F.when(r, x.p))
    df = df.withColumn("at", F.sort_array(F.array_compact(repeated)))
    covered = F.zip_with("at", F.slice("at", F.lit(2), F.greatest(F.size("at"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def judge(docs: DataFrame, trusted: DataFrame, buckets: int = 1 << 16, smooth: float = 20.0, threshold: float = 0.0, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: base counts, base_failed, llr (mean log ratio) and kept."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    weights = ratios(docs, trusted, buckets, smooth)
    table = F.from_json(F.lit(str(weights)), F.lit("array<int>"))
    df = docs.withColumn("w", words(F.col("text"))).withColumn("pairs", _pairs(F.col("w")))
    df = df.withColumn("grams", _ngrams(F.col("w"), F.col("pairs")))
    total = F.aggregate("grams", F.lit(0).cast("long"), lambda s, g: s + F.element_at(table, (F.pmod(g, F.lit(buckets)) + 1).cast("int")))
    df = df.withColumn("total", total).withColumn("n_grams", F.size("grams"))
    df = base_rules(df)
    df = df.withColumn("llr", F.when(F.col("n_grams") > 0, F.col("total") / (F.col("n_grams") * F.lit(SCALE))).otherwise(F.lit(0.0)))
    kept = ~F.col("base_failed") & (F.col("total") >= F.lit(round(threshold * SCALE)) * F.col("n_grams"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "llr")
