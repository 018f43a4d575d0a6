"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

Evidence of a document: a logistic regression over the shares of hashed words and word
shapes, fitted on a bounded sample of labelled documents and less its base rate, so that it
is a log likelihood ratio. Prior of a document: the mean evidence-based probability of its
path, shrunk towards that of its host, which is shrunk towards the corpus; the strengths
of shrinking are moment estimates from the spread of the groups' means. The document
itself is left out of its own prior. Sums over hosts and paths are grouped aggregations
with partial sums in every task, so a host with a third of all rows is a few rows when
shuffled.

Defined results: a null or empty text has evidence 0 and rests on its prior; null hosts
and paths are groups of their own; rows with equal ids are judged one by one; of several
labels of one id the greatest counts, and of its texts the one with the smallest hash; without
labels of both kinds all evidence is 0 and every document is kept; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import labelled_sample, lean, small_batches, stored

_split = re.compile(r"[^\x20\x09-\x0D]+").findall
_shape = [(re.compile(p), r) for p, r in ((r"[a-zß-öø-ÿ]+", "a"), (r"[A-ZÀ-ÖØ-Þ]+", "A"), (r"[0-9]+", "0"))]
_runs = re.compile(r"(.)\1+", re.S)
CACHE = 100_000
#: Characters of the labelled sample, at most.
MOST_CHARS = 64 << 20


def word_shape(word: str) -> str:
    """Classes of characters, runs as one: 'The&&&' is 'Aa&'."""
    for p, r in _shape:
        word = p.sub(r, word)
    return _runs.sub(r"\1", word)


class Words:
    """Rows of hashed features for words, kept until there are CACHE of them."""

    def __init__(self, buckets: int):
        self.buckets, self.known, self.rows = buckets, {}, []

    def __call__(self, text: str) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known.clear()
        get, out = self.known.get, []
        for w in _split(text):
            at = get(w)
            if at is None:
                shape = zlib.crc32(word_shape(w).encode(), 1) % self.buckets
                at = self.known[w] = (zlib.crc32(w.encode()) % self.buckets) << 32 | shape
            out.append(at)
        return np.array(out, np.int64)


class Evidence:
    """Logistic regression on shares of hashed words and shapes."""

    def __init__(self, buckets: int = 1 << 15):
        self.buckets, self.weights, self.scale = buckets, np.zeros((2, buckets)), 10.0

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of = Words(self.buckets)
        each = [of(t) for t in texts]
        sizes = np.array([len(e) for e in each])
        flat = np.concatenate(each) if each else np.zeros(0, np.int64)
        return flat >> 32, flat & 0xFFFFFFFF, sizes

    def fit(self, texts: list[str], labels: np.ndarray, steps: int = 120, rate: float = 0.05, decay: float = 1e-5) -> Evidence:
        words, shapes, sizes = self.features(texts)
        base = np.log(labels.mean() / (1 - labels.mean()))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        share = self.scale / np.maximum(sizes, 1)[doc]
        m, v = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for step in range(1, steps + 1):
            z = np.bincount(doc, (self.weights[0, words] + self.weights[1, shapes]) * share, len(sizes))
            slope = (1 / (1 + np.exp(-np.clip(z + base, -30, 30))) - labels) / len(labels)
            per = slope[doc] * share
            g = np.stack([np.bincount(words, per, self.buckets), np.bincount(shapes, per, self.buckets)]) + decay * self.weights
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            self.weights -= rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, of: Words, text: str | None) -> float:
        at = of(text or "")
        if not len(at):
            return 0.0
        return float((self.weights[0, at >> 32] + self.weights[1, at & 0xFFFFFFFF]).mean() * self.scale)


def fit_evidence(docs: DataFrame, labels: DataFrame, most: int = 6000, most_chars: int = MOST_CHARS) -> tuple[Evidence, float]:
    """The model and the base rate, from at most `most` labelled documents with `most_chars`
    characters together, in the order of a hash of their ids.

    docs: doc_id, text; labels: doc_id, quality. An id with several labels has the greatest
    one. Only the sample's ids are broadcast, and only its texts come to the driver.
    """
    ids = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    rows = labelled_sample(docs, ids.orderBy(*order).limit(most), order, most_chars)
    y = np.array([r["quality"] for r in rows], float)
    model = Evidence()
    if len(rows) and 0 < y.mean() < 1:
        model.fit([r["text"] or "" for r in rows], y)
    rate = float(y.mean()) if len(rows) else 0.5
    return model, min(max(rate, 0.01), 0.99)


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def strength(means: DataFrame, overall: float, least: float = 2.0, most: float = 1000.0) -> float:
    """How many documents the prior of a group is worth: moment estimate from (n, mean) of the groups."""
    row = means.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * (F.col("mean") - overall) ** 2).alias("spread"), F.sum(F.col("n") * F.col("n")).alias("square")).first()
    if not row["n"] or row["k"] < 2 or not 0 < overall < 1:
        return most
    inside = overall * (1 - overall)
    effective = row["n"] - row["square"] / row["n"]
    between = (row["spread"] - (row["k"] - 1) * inside) / effective if effective > 0 else 0.0
    return float(min(max(inside / between - 1 if between > 0 else most, least), most))


def classify(docs: DataFrame, labels: DataFrame, most: int = 6000, threshold: float = 0.5, keep: list[str] | None = None, id_col="doc_id", text_col="text", host_col="source", path_col="lang") -> DataFrame:
    """One row per document: doc_id, evidence, host_posterior, path_posterior, score, kept (and `row`, a struct of the columns in `keep`).

    A path is (host, path_col). score is the posterior probability of good quality.
    """
    small_batches(docs.sparkSession)
    carried = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []
    inside = text_col in (keep or [])  # the text goes through Python once
    texts = [] if inside else [F.col(text_col).alias("text")]
    rows = docs.select(F.col(id_col).alias("doc_id"), *texts, F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), *carried)
    model, rate = fit_evidence(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, most)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        of = Words(shared.value.buckets)
        for b in batches:
            text = b.column("row").field(text_col) if inside else b.column("text")
            found = [shared.value.score(of, t.as_py()) for t in text]
            names = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(found, pa.float64())], [*names, "evidence"])

    schema = rows.drop("text").limit(0).select("*", F.lit(0.0).alias("evidence")).schema
    rows = stored(rows.mapInArrow(lean(score), schema))
    base = float(np.log(rate / (1 - rate)))
    p = 1 / (1 + F.exp(-(F.col("evidence") + base)))
    paths = stored(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    overall = total["s"] / total["n"] if total["n"] else 0.5
    of_host = strength(hosts.withColumn("mean", F.col("s") / F.col("n")), overall)
    of_path = strength(paths.withColumn("mean", F.col("s") / F.col("n")), overall)
    groups = paths.select(F.col("host").alias("g_host"), F.col("path").alias("g_path"), F.col("n").alias("path_n"), F.col("s").alias("path_s"))
    sites = hosts.select(F.col("host").alias("h_host"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    groups = groups.join(sites, F.col("g_host").eqNullSafe(F.col("h_host")))
    judged = rows.join(groups, rows["host"].eqNullSafe(F.col("g_host")) & rows["path"].eqNullSafe(F.col("g_path")))
    host = (F.col("host_s") - p + of_host * overall) / (F.col("host_n") - 1 + of_host)
    judged = judged.withColumn("host_posterior", host)
    path = (F.col("path_s") - p + of_path * F.col("host_posterior")) / (F.col("path_n") - 1 + of_path)
    judged = judged.withColumn("path_posterior", path)
    z = F.col("evidence") + _logit(F.col("path_posterior"))
    judged = judged.withColumn("score", 1 / (1 + F.exp(-z)))
    return judged.select("doc_id", "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= threshold).alias("kept"), *(["row"] if keep else []))
