"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected r = target / size-of-source times. Along the
source's documents, largest first, the expected copies are summed up; one offset in
[0, 1) is added, and a document is emitted once for each integer that its step crosses.
As the order is by size, the words taken miss the target by no more than the words of
the source's largest document.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; rows with equal ids count one by one; a source without words has target 0 and
nothing taken; an empty table gives an empty result; other columns are ignored by
``mix`` and carried by ``emit``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import ranked, stored, words


def targets(sizes: DataFrame, weights=(5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, target): shares of all sizes by weight, none above `most` times its source.

    What a capped source cannot take goes to the others by weight. At the end every
    source that is not capped gets `level` times its weight; each pass sums the sources
    up into one row, so that the driver sees single numbers.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sums = ranked(sums, [], [F.col("source").asc_nulls_last()], "place")
    nth = (F.col("place") - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (nth + 1).cast("int"))
    sums = stored(sums.withColumn("weight", weight.cast("long")))
    cap = F.lit(most) * F.col("source_size")
    total = sums.agg(F.sum("source_size")).first()[0] or 0
    level, free = 0.0, None
    while True:
        over = F.lit(level) * F.col("weight") > cap if free is not None else F.lit(False)
        row = sums.agg(F.sum(F.when(over, cap)).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("free")).first()
        if row["free"] is None or row["free"] == free:
            break
        free = row["free"]
        level = (total - (row["capped"] or 0)) / free
    share = F.lit(float(level)) * F.col("weight")
    target = F.when(share > cap, cap.cast("double")).otherwise(share)
    return sums.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def offset(source, seed: str):
    """One number in [0, 1) for each source, the same in every run."""
    hexes = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")))), 1, 8)
    return F.conv(hexes, 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights=(5, 2, 1), most: int = 3, seed: str = "mix", id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, text_hash."""
    text = F.col(text_col)
    sizes = stored(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.size(words(text)).cast("long").alias("size"), F.xxhash64(text).alias("text_hash"),
    ))
    goal = targets(sizes, weights, most).withColumnRenamed("source", "goal_source")
    order = [F.col("size").desc(), F.col("doc_id").asc_nulls_last(), F.col("text_hash").asc()]
    rows = ranked(sizes, ["source"], order)
    rows = rows.join(goal, rows["source"].eqNullSafe(goal["goal_source"]))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    rows = rows.withColumn("rate", rate).withColumn("offset", offset(F.col("source"), seed))
    crossed = F.floor(F.col("rank") * F.col("rate") + F.col("offset")) - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("offset"))
    copies = F.least(crossed, F.lit(most)).cast("long")
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"), "text_hash",
    )


def emit(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it.

    Rows that agree in id, source and text are interchangeable; they are numbered, so
    that each gets the copies of one of them.
    """
    id_col, text_col, source_col = options.get("id_col", "doc_id"), options.get("text_col", "text"), options.get("source_col", "source")
    keys = ["_id", "_source", "_hash"]
    plan = mix(docs, **options).where(F.col("copies") > 0)
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(F.lit(0)))
    most_first = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("_copies").desc()))
    plan = plan.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_hash"), F.col("copies").alias("_copies"))
    plan = plan.withColumn("_nth", most_first).select(*[F.col(c).alias(f"_p{c}") for c in [*keys, "_nth", "_copies"]])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.xxhash64(F.col(text_col)).alias("_hash"))
    rows = rows.withColumn("_nth", nth)
    cond = F.lit(True)
    for c in [*keys, "_nth"]:
        cond = cond & rows[c].eqNullSafe(plan[f"_p{c}"])
    taken = rows.join(plan, cond).select("_row", F.explode(F.sequence(F.lit(1), F.col("_p_copies").cast("int"))).alias("_copy"))
    return taken.select("_row.*")
