"""Line dedup by overlapping windows of three lines.

Every three consecutive lines of a document, at least one of them with a word, are a
window, known by a 128-bit hash. Of the windows that occur more than once in the corpus,
the first occurrence (in order of document id, text hash and place) stays; the lines that
any later occurrence covers go. Whatever goes is still there at an earlier place: each
line of a later occurrence has its twin in the first one, at a smaller id or place.

Occurrences are summed up to one row for each window before anything is joined; a window
that a third of all documents share is joined where its occurrences are, see `with_sums`.

Defined results: a null text stays null, with no lines; a document of fewer than three
lines stays as it is; a document that repeats its own lines loses the later ones; rows
that agree in id and text are one document and get equal results; null ids come first
in order; empty tables give empty results; other columns are carried if asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, WORD, stored, with_sums

WINDOW = 3


def _windows(lines: Column) -> Column:
    n = F.greatest(F.size(lines) - (WINDOW - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(lines, F.lit(i + 1), n).alias(f"l{i}") for i in range(WINDOW)])


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, places): where later occurrences start, in order. docs: doc_id, text."""
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n", -1).alias("lines"))
    rows = rows.select("doc_id", "text_hash", F.posexplode(_windows(F.col("lines"))).alias("place", "w"))
    rows = rows.where(F.col("w.l0").rlike(WORD) | F.col("w.l1").rlike(WORD) | F.col("w.l2").rlike(WORD))
    parts = [F.col(f"w.l{i}") for i in range(WINDOW)]
    at = F.struct("doc_id", "text_hash", "place")
    rows = rows.select(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2"), at.alias("at"))
    firsts = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).where("n > 1")
    firsts = stored(firsts)
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    later = with_sums(rows, firsts, ["h1", "h2"], "n", total).where(~F.col("at").eqNullSafe(F.col("first")))
    return later.groupBy("at.doc_id", "at.text_hash").agg(F.sort_array(F.collect_set("at.place")).alias("places"))


def dedup_lines(docs: DataFrame, columns: list[str] | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed (spans first-last, 0-based), text without the lines covered, and a struct `row` of the columns asked for."""
    carried = [F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")] if columns else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carried)
    places = stored(repeated(rows.select("doc_id", "text")).select(F.col("doc_id").alias("p_id"), F.col("text_hash").alias("p_hash"), "places"))
    size = places.agg(F.coalesce(F.sum(F.size("places") + 8), F.lit(0))).first()[0]
    small = size <= 4 * BROADCAST_ROWS  # the table has that many numbers, at most
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    rows = rows.join(F.broadcast(places) if small else places, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("text_hash") == F.col("p_hash")), "left")
    none = F.array().cast("array<int>")
    rows = rows.withColumn("p", F.coalesce("places", none)).withColumn("lines", F.split("text", "\n", -1))
    # Lines between one covered place and the next; places lie in order, and each covers WINDOW lines.
    gaps = F.zip_with(F.concat(F.array(F.lit(-WINDOW)), F.col("p")), F.concat(F.col("p"), F.array(F.size("lines"))), lambda a, b: F.struct((a + WINDOW).alias("s"), F.greatest(b - a - WINDOW, F.lit(0)).alias("n")))
    rows = rows.withColumn("gaps", F.when(F.size("p") > 0, gaps))
    left = F.flatten(F.transform("gaps", lambda g: F.slice(F.col("lines"), g.s + 1, g.n)))
    rows = rows.withColumn("left", F.when(F.col("gaps").isNotNull(), left))
    # A span of removed lines ends where a gap that isn't empty starts.
    inner = F.filter("gaps", lambda g: g.n > 0)
    rows = rows.withColumn("inner", F.concat(F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("n"))), inner, F.array(F.struct(F.size("lines").alias("s"), F.lit(0).alias("n")))))
    spans = F.zip_with(F.col("inner"), F.slice("inner", F.lit(2), F.size("inner")), lambda a, b: F.when(b.s > a.s + a.n, F.concat((a.s + a.n).cast("string"), F.lit("-"), (b.s - 1).cast("string"))))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    return rows.select(
        "doc_id", n_lines.alias("n_lines"), F.coalesce(F.size("lines") - F.size("left"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.array_compact(spans), ","), F.lit("")).alias("removed"),
        F.when(F.col("left").isNull(), F.col("text")).otherwise(F.array_join("left", "\n")).alias("text"), *(["row"] if columns else []),
    )
