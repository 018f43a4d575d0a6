"""Column profiles: counts, extremes, means, exact medians, frequencies and types."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.compiler import kind_of
from .view import as_text, quoted

TOP = 40


def _number(df: DataFrame, name: str) -> Column:
    return quoted(name).cast("double") if kind_of(df.schema[name].dataType) in ("int", "float") else quoted(name).try_cast("double")


#: The figures of a profile, in order.
FIGURES = ["non_null", "distinct", "min_text", "max_text", "min_length", "max_length", "numbers", "sum", "mean", "min", "max"]


def profile(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """One row per column: counts, distinct values, extremes as text and as numbers, sum,
    mean, least and greatest byte length. An empty text counts as NULL.

    Each column is grouped by value on a scan of it alone, and all figures follow from the
    groups: every task sends a value once, and no row is multiplied by the columns.
    `approximate` takes all columns in one pass without an exchange of values and counts
    distinct values by a sketch.
    """
    columns = columns or df.columns
    found = _sketched(df, columns) if approximate else reduce(DataFrame.unionByName, [_by_value(df, c) for c in columns])
    return found.withColumn("nulls", F.col("total") - F.col("non_null"))


def _by_value(df: DataFrame, name: str) -> DataFrame:
    one = df.select(as_text(df, name).alias("text"), _number(df, name).alias("number"))
    groups = one.groupBy(F.when(F.col("text") != "", F.col("text")).alias("text")).agg(
        F.count(F.lit(1)).alias("n"), F.count("number").alias("numbers"), F.sum("number").alias("sum"), F.min("number").alias("min"), F.max("number").alias("max")
    )
    size, total = F.octet_length("text"), lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return groups.agg(
        total(F.col("n")).alias("total"), total(F.when(F.col("text").isNotNull(), F.col("n"))).alias("non_null"), F.count("text").alias("distinct"),
        F.min("text").alias("min_text"), F.max("text").alias("max_text"), F.min(size).alias("min_length"), F.max(size).alias("max_length"),
        total(F.col("numbers")).alias("numbers"), F.sum("sum").alias("sum"), F.try_divide(F.sum("sum"), F.sum("numbers")).alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"),
    ).select(F.lit(name).alias("column"), F.lit(kind_of(df.schema[name].dataType)).alias("type"), "total", *FIGURES)


def _sketched(df: DataFrame, columns: list[str]) -> DataFrame:
    parts: list[Column] = []
    for i, c in enumerate(columns):
        text, number = as_text(df, c), _number(df, c)
        full = F.when(text != "", text)
        values = [
            F.count(full), F.approx_count_distinct(full), F.min(full), F.max(full), F.min(F.octet_length(full)), F.max(F.octet_length(full)),
            F.count(number), F.sum(number), F.avg(number), F.min(number), F.max(number),
        ]
        parts += [v.alias(f"{i}_{n}") for n, v in zip(FIGURES, values, strict=True)]
    sums = df.agg(F.count(F.lit(1)).alias("total"), *parts)
    row = lambda i, c: F.struct(F.lit(c).alias("column"), F.lit(kind_of(df.schema[c].dataType)).alias("type"), "total", *[F.col(f"{i}_{n}").alias(n) for n in FIGURES])
    return sums.select(F.explode(F.array(*[row(i, c) for i, c in enumerate(columns)])).alias("r")).select("r.*")


def value_frequency(df: DataFrame, column: str, top: int = TOP) -> DataFrame:
    """The most frequent values: count descending, then value."""
    return df.groupBy(quoted(column).alias("value")).agg(F.count(F.lit(1)).alias("frequency")).orderBy(F.desc("frequency"), F.asc("value")).limit(top)


def exact_quantile_pair(df: DataFrame, column: str) -> DataFrame:
    """(median): the middle value, or the mean of the middle two, without gathering the column in one place.

    Values are counted and the counts range-partitioned; the partitions' sums, one row
    each, say which of them hold the middle, and only those are gone through. It is
    computed at once, and what it keeps meanwhile is released.
    """
    counts = df.where(quoted(column).isNotNull()).groupBy(quoted(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    pieces = counts.repartitionByRange("v").withColumn("piece", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    try:
        sums = dict(pieces.groupBy("piece").agg(F.sum("n")).collect())
        total, wanted = sum(sums.values()), F.lit(False)
        so_far = F.sum("n").over(W.partitionBy("piece").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
        holding, last = set(), F.col("last")
        for place in {(total + 1) // 2, total // 2 + 1} if total else ():
            piece, before = 0, 0
            while before + sums.get(piece, 0) < place:
                before += sums.get(piece, 0)
                piece += 1
            holding.add(piece)
            wanted |= (F.col("piece") == piece) & (last >= place - before) & (last - F.col("n") < place - before)
        middle = [r["v"] for r in pieces.where(F.col("piece").isin(holding)).withColumn("last", so_far).where(wanted).collect()] if total else []
    finally:
        pieces.unpersist()
    found = sum(middle) / len(middle) if middle else None
    return df.sparkSession.range(1).select(F.lit(found).cast("double").alias("median"))


def median(df: DataFrame, column: str) -> DataFrame:
    """Exact median by Spark's percentile; for columns whose distinct values fit one task."""
    return df.agg(F.median(quoted(column)).alias("median"))


def dominant_type(df: DataFrame, column: str, share: float = 0.9) -> str:
    """The type of more than `share` of the non-empty cells of a text column, else Mixed."""
    c = quoted(column).cast("string")
    low = F.lower(c)
    kind = (
        F.when(low.isin("true", "false"), "Boolean").when(c.rlike(r"^[+-]?\d+$"), "Integer").when(c.try_cast("double").isNotNull(), "Float")
        .when(c.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), "DateTime").otherwise("String")
    )
    found = df.where(c.isNotNull() & (c != "")).groupBy(kind.alias("kind")).count().collect()
    total = sum(r["count"] for r in found)
    return next((r["kind"] for r in found if r["count"] > share * total), "Mixed") if total else "Null"


def memory_size(df: DataFrame) -> int:
    """Bytes of the cells as a reader sees them, an estimate of what the table takes: 8 for a number, the bytes of a text."""
    size = lambda c: F.lit(8) if kind_of(df.schema[c].dataType) in ("int", "float") else F.octet_length(quoted(c).cast("string"))
    cells = [F.when(quoted(c).isNotNull(), size(c)).otherwise(0).cast("long") for c in df.columns]
    return df.agg(F.sum(reduce(lambda a, b: a + b, cells, F.lit(0)))).first()[0] or 0


def table_stats(df: DataFrame) -> DataFrame:
    """Rows, columns, NULLs over all columns, in one pass."""
    nulls = reduce(lambda a, b: a + b, [F.sum(quoted(c).isNull().cast("long")) for c in df.columns], F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"), F.coalesce(nulls, F.lit(0)).cast("long").alias("nulls"))
