"""Flow analytics over orders, fills and their snapshots.

All of it is grouped aggregation or windows partitioned by the order, so that an order's
rows meet in one task and orders spread over all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _so_far(key: list[str], order: list[str]):
    return W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)


def running_vwap(fills: DataFrame, key: list[str], order: list[str], quantity: str, price: str, ordered: str | None = None) -> DataFrame:
    """Each fill with what is filled so far, the volume-weighted average price, and, given
    the ordered quantity, what remains, the share filled in percent and the state."""
    over = _so_far(key, order)
    out = fills.withColumn("filled_quantity", F.sum(quantity).over(over))
    out = out.withColumn("average_price", F.try_divide(F.sum(F.col(quantity) * F.col(price)).over(over), F.col("filled_quantity")))
    if ordered:
        out = out.withColumn("remaining_quantity", F.col(ordered) - F.col("filled_quantity"))
        out = out.withColumn("fill_percentage", F.try_divide(F.col("filled_quantity") * 100, F.col(ordered)))
        out = out.withColumn("state", F.when(F.col("filled_quantity") == 0, "NEW").when(F.col("remaining_quantity") <= 0, "FILLED").otherwise("PARTIALLY_FILLED"))
    return out


def running_distinct(df: DataFrame, key: list[str], order: list[str], value: str, name: str = "distinct_so_far") -> DataFrame:
    """How many different values there have been so far: first sightings, summed up."""
    first = F.row_number().over(W.partitionBy(*key, value).orderBy(*order)) == 1
    out = df.withColumn("__first", (first & F.col(value).isNotNull()).cast("long"))
    return out.withColumn(name, F.sum("__first").over(_so_far(key, order))).drop("__first")


def sequence(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Number of each row within its key, and how many there are."""
    return df.withColumn("seq", F.row_number().over(W.partitionBy(*key).orderBy(*order))).withColumn("of", F.count(F.lit(1)).over(W.partitionBy(*key)))


def running_sum(df: DataFrame, key: list[str], order: list[str], value: str, name: str = "running") -> DataFrame:
    return df.withColumn(name, F.sum(value).over(_so_far(key, order)))


def gap_minutes(df: DataFrame, key: list[str], time: str, name: str = "gap_minutes", ties: list[str] | None = None) -> DataFrame:
    """Minutes since the row before."""
    before = F.lag(time).over(W.partitionBy(*key).orderBy(time, *(ties or [])))
    return df.withColumn(name, F.timestamp_diff("MICROSECOND", before, F.col(time)) / F.lit(6e7))


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: a grouped maximum with partial sums, no window."""
    rest = [c for c in df.columns if c not in key and c not in order]
    best = df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("__r"))
    return best.select(*[F.col(c) if c in key else F.col(f"__r.{c}").alias(c) for c in df.columns])


def buckets(time: Column, minutes: int) -> Column:
    """Start of the time bucket."""
    return F.window(time, f"{minutes} minutes")["start"]


def bucket_totals(df: DataFrame, time: str, minutes: int, value: str) -> DataFrame:
    """Sum by time bucket, and the running total over the buckets."""
    sums = df.groupBy(buckets(F.col(time), minutes).alias("bucket")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    return sums.withColumn("running_total", F.sum("total").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)))


def urgency(participation: Column) -> Column:
    """CRITICAL from 95 %, HIGH from 85 %, MEDIUM from 70 %, else LOW."""
    return F.when(participation >= 95, "CRITICAL").when(participation >= 85, "HIGH").when(participation >= 70, "MEDIUM").otherwise("LOW")


def schedule(orders: DataFrame, curve: list[float], key: str, quantity: str) -> DataFrame:
    """An order's quantity over the slots of a volume curve, rounded down; the last slot takes the rest."""
    total = sum(curve)
    n = len(curve)
    shares = F.array(*[F.lit(float(c) / total) for c in curve])
    slots = orders.select(key, quantity, F.posexplode(shares).alias("slot", "share"))
    part = F.floor(F.col(quantity) * F.col("share"))
    before = F.sum(part).over(W.partitionBy(key).orderBy("slot").rowsBetween(W.unboundedPreceding, -1))
    planned = F.when(F.col("slot") == n - 1, F.col(quantity) - F.coalesce(before, F.lit(0))).otherwise(part)
    return slots.withColumn("planned", planned.cast("double")).select(key, "slot", "planned")


def roll_up(leaf: DataFrame, levels: list[tuple[DataFrame, str, str]], sums: dict[str, Column]) -> DataFrame:
    """Aggregates of leaves at the top of a hierarchy of fixed depth.

    levels: (table, key in the table, name of the key in what is below), from the lowest
    level up; every join is an equi-join on one key.
    """
    out = leaf
    for table, key, below in levels:
        out = out.join(table, out[below] == table[key])
    top = levels[-1][1]
    return out.groupBy(top).agg(*[c.alias(n) for n, c in sums.items()])


def retries(df: DataFrame, key: list[str], attempt: str, extra: Column | None = None) -> DataFrame:
    """Left self-join: each attempt with the next one of the same key."""
    nxt = df.select(*[F.col(c).alias(f"next_{c}") for c in df.columns])
    cond = F.col(f"next_{attempt}") == F.col(attempt) + 1
    for k in key:
        cond = cond & (F.col(k) == F.col(f"next_{k}"))
    return df.join(nxt, cond if extra is None else cond & extra, "left")


def with_parents(df: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """The rows whose parent is among `parents`, once each."""
    wanted = parents.select(F.col(parent_key).alias("__parent"))
    return df.join(wanted, F.col(key) == F.col("__parent"), "left_semi")


def off_average(df: DataFrame, key: str, value: str, name: str = "off") -> DataFrame:
    """The distance of each value to the mean of its key. The means are grouped sums, joined back, so that
    no key has to meet in one task; AQE broadcasts them if they are small."""
    means = df.groupBy(F.col(key).alias("__key")).agg(F.avg(value).alias("__mean"))
    out = df.join(means, F.col(key).eqNullSafe(F.col("__key")), "left")
    return out.withColumn(name, F.col(value) - F.col("__mean")).drop("__key", "__mean")


def last_before(df: DataFrame, other: DataFrame, key: list[str], time: str, order: list[str], values: dict[str, str]) -> DataFrame:
    """As-of join: each row of df with the latest row of `other` of the same key, up to and at its time.

    Both sides in one stream by key and time, the last seen values carried on: a sort, no
    pairs. Rows of `other` at the same time come first; of several such, `order` decides.
    values: column of other -> name in the result, NULL where there is none.
    """
    seen = F.struct(*[F.col(v).alias(n) for v, n in values.items()])
    left = df.withColumns({"__side": F.lit(1), "__seen": F.lit(None)})
    right = other.select(*key, time, *[o for o in order if o not in [*key, time]], F.lit(0).alias("__side"), seen.alias("__seen"))
    both = left.unionByName(right, allowMissingColumns=True)
    over = W.partitionBy(*key).orderBy(time, "__side", *order).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("__seen", F.last("__seen", ignorenulls=True).over(over)).where("__side = 1")
    return found.select(*[F.col(c) for c in df.columns], *[F.col(f"__seen.{n}").alias(n) for n in values.values()])


def within(points: DataFrame, spans: DataFrame, key: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Range join: pairs of a point and a span of the same key with start <= at < end (timestamps).

    A span is listed in every bucket of `width` seconds that it touches, a point in its
    own, so that both meet on (key, bucket) and a busy key is spread over its buckets.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(width * 1_000_000)).cast("long")
    here = points.withColumn("__bucket", bucket(at))
    touched = F.explode(F.sequence(bucket(start), bucket(end)))
    there = spans.where(F.col(start) < F.col(end)).withColumn("__bucket", touched).withColumnsRenamed({k: f"__{k}" for k in key}).withColumnRenamed("__bucket", "__there")
    cond = F.col("__bucket") == F.col("__there")
    for k in key:
        cond = cond & (F.col(k) == F.col(f"__{k}"))
    found = here.join(there, cond & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))
    return found.drop("__bucket", "__there", *[f"__{k}" for k in key])


def scorecard(df: DataFrame, key: list[str], state: str, full: str, parts: dict[str, str], bad: str) -> DataFrame:
    """By key (say, a venue): rows, rows in the state `full` and their share in percent, rows in each
    state of `parts` (state -> name), and a verdict: FADING if any is in the state `bad`, else OK."""
    has = lambda s: F.count_if(F.col(state) == s)
    out = df.groupBy(*key).agg(F.count(F.lit(1)).alias("total"), has(full).alias("filled"), *[has(s).alias(n) for s, n in parts.items()], has(bad).alias("bad"))
    share = F.col("filled") * 100 / F.col("total")
    return out.withColumn("fill_rate", share).withColumn("status", F.when(F.col("bad") > 0, "FADING").otherwise("OK"))


def periods(df: DataFrame, key: list[str], time: str, filled: str, slow: float = 5, ties: list[str] | None = None) -> DataFrame:
    """The stretches between a key's rows: from, to, minutes, how much was filled, and a diagnosis:
    STUCK without any progress, SLOW if longer than `slow` minutes, else NORMAL."""
    over = W.partitionBy(*key).orderBy(time, *(ties or []))
    out = gap_minutes(df, key, time, ties=ties).withColumns({"from_time": F.lag(time).over(over), "__before": F.lag(filled).over(over)})
    progress = F.col(filled) - F.col("__before")
    diagnosis = F.when(progress == 0, "STUCK").when(F.col("gap_minutes") > slow, "SLOW").otherwise("NORMAL")
    return out.where(F.col("from_time").isNotNull()).withColumns({"fills_in_period": progress, "diagnosis": diagnosis}).drop("__before")


def stuck(df: DataFrame, key: list[str], time: str, filled: str, total: str, now: Column, minutes: float = 30) -> DataFrame:
    """Keys that aren't filled, with no row in the last `minutes`: last time, progress, minutes since."""
    out = df.groupBy(*key).agg(F.max(time).alias("last_time"), F.max(filled).alias("last_filled"), F.max(total).alias("total"))
    since = F.timestamp_diff("MICROSECOND", F.col("last_time"), now) / F.lit(6e7)
    return out.withColumn("minutes_since", since).where((F.col("last_filled") < F.col("total")) & (F.col("minutes_since") > minutes))


def lost_share(df: DataFrame, lost: Column, quantity: str, ordered: Column) -> DataFrame:
    """One row, from one pass: the quantity of the rows that `lost` marks, the greatest order, and the share in percent."""
    out = df.agg(F.sum(F.when(lost, F.col(quantity))).alias("lost"), F.max(ordered).alias("ordered"))
    return out.withColumn("lost_pct", F.try_divide(F.col("lost") * 100, F.col("ordered")))


def execution_report(df: DataFrame, key: list[str], ordered: str, filled: str, price: str, events: dict[str, Column]) -> DataFrame:
    """By key: greatest ordered and filled quantity, what is open, share in percent, volume-weighted price of the
    fills, how many rows each of `events` marks, and an assessment: POOR below 50 %, FAIR below 90 %, else GOOD."""
    out = df.groupBy(*key).agg(
        F.max(ordered).alias("order_size"), F.sum(filled).alias("filled"), F.try_divide(F.sum(F.col(filled) * F.col(price)), F.sum(filled)).alias("vwap"),
        *[F.count_if(c).alias(n) for n, c in events.items()],
    )
    rate = F.try_divide(F.col("filled") * 100, F.col("order_size"))
    out = out.withColumns({"unfilled": F.col("order_size") - F.col("filled"), "fill_rate": rate})
    return out.withColumn("quality", F.when(F.col("fill_rate") < 50, "POOR").when(F.col("fill_rate") < 90, "FAIR").otherwise("GOOD"))
