"""Flows as streams: time buckets, and the running price of every order.

Both give, over a finished stream, what the batch operators give over its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RUNNING = "key string, seq long, time timestamp, filled_quantity double, average_price double"


def bucket_counts(events: DataFrame, time: str, minutes: int, late: str = "10 minutes", by: list[str] | None = None, value: str | None = None) -> DataFrame:
    """Counts (and sums) by time bucket; a bucket is out once the watermark has passed it."""
    sums = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    timed = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    out = timed.groupBy(F.window("__t", f"{minutes} minutes"), *(by or [])).agg(*sums)
    return out.select(F.col("window.start").alias("bucket"), *(by or []), "n", *(["total"] if value else []))


def _running(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seq, quantity, amount = state.get if state.exists else (0, 0.0, 0.0)
    rows = pd.concat(list(batches)).sort_values(["time", "id"], kind="stable")
    filled = quantity + rows["quantity"].cumsum()
    spent = amount + (rows["quantity"] * rows["price"]).cumsum()
    state.update((seq + len(rows), float(filled.iloc[-1]), float(spent.iloc[-1])))
    yield pd.DataFrame({
        "key": str(key[0]), "seq": range(seq + 1, seq + len(rows) + 1), "time": rows["time"],
        "filled_quantity": filled, "average_price": (spent / filled).where(filled != 0),
    })


def running_price(fills: DataFrame, key: str, time: str, identity: str, quantity: str, price: str) -> DataFrame:
    """Each fill with the quantity and average price so far; the state of an order is three numbers.

    Fills of one batch are ordered by time and identity; batches must come in order of time.
    """
    rows = fills.select(
        F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("time"), F.col(identity).alias("id"),
        F.col(quantity).cast("double").alias("quantity"), F.col(price).cast("double").alias("price"),
    )
    return rows.groupBy("key").applyInPandasWithState(_running, RUNNING, "seq long, quantity double, amount double", "append", GroupStateTimeout.NoTimeout)
