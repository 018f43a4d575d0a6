from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera import streaming
from tessera.operators import flows

T0 = datetime(2024, 1, 1, 9)
FILLS = [(i, f"o{i % 3}", T0 + timedelta(minutes=7 * i), float(10 + i), 100.0 + i % 4, "XYZ"[i % 2]) for i in range(12)]
SCHEMA = "id long, o string, t timestamp, quantity double, price double, venue string"


@pytest.fixture(scope="module")
def fills(spark):
    return spark.createDataFrame(FILLS, SCHEMA).persist()


def python_vwap():
    out, state = {}, {}
    for i, o, t, qty, price, _ in sorted(FILLS, key=lambda r: (r[2], r[0])):
        a, b = state.get(o, (0.0, 0.0))
        state[o] = (a + qty, b + qty * price)
        out[i] = (state[o][0], state[o][1] / state[o][0])
    return out


def test_running_vwap(fills):
    got = flows.running_vwap(fills.withColumn("ordered", F.lit(60.0)), ["o"], ["t", "id"], "quantity", "price", "ordered").collect()
    want = python_vwap()
    for r in got:
        assert r["filled_quantity"] == want[r["id"]][0] and abs(r["average_price"] - want[r["id"]][1]) < 1e-9
        assert r["state"] == ("FILLED" if r["filled_quantity"] >= 60 else "PARTIALLY_FILLED")


def test_distinct_sequence_latest(fills):
    got = {r["id"]: (r["distinct_so_far"], r["seq"], r["of"]) for r in flows.sequence(flows.running_distinct(fills, ["o"], ["t"], "venue"), ["o"], ["t"]).collect()}
    assert got[0] == (1, 1, 4) and got[3] == (2, 2, 4) and got[9] == (2, 4, 4)
    assert {r["o"]: r["id"] for r in flows.latest(fills, ["o"], ["t", "id"]).collect()} == {"o0": 9, "o1": 10, "o2": 11}


def test_gaps_schedule_retries(spark, fills):
    got = {r["id"]: r["gap_minutes"] for r in flows.gap_minutes(fills, ["o"], "t").collect()}
    assert got[0] is None and got[3] == 21.0
    orders = spark.createDataFrame([("a", 101.0)], "k string, q double")
    assert [r["planned"] for r in flows.schedule(orders, [1, 1, 2], "k", "q").orderBy("slot").collect()] == [25.0, 25.0, 51.0]
    tries = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "k int, attempt int, v string")
    assert sorted((r["k"], r["attempt"], r["next_v"] or "") for r in flows.retries(tries, ["k"], "attempt").collect()) == [(1, 1, "y"), (1, 2, ""), (2, 1, "")]


def test_urgency(spark):
    df = spark.createDataFrame([(95.0,), (94.9,), (70.0,), (1.0,)], "p double")
    assert [r[0] for r in df.select(flows.urgency(F.col("p"))).collect()] == ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def stream(spark, fills, tmp_path):
    path = str(tmp_path / "in")
    for i in range(3):  # a file a batch, in order of time
        fills.where((F.col("id") >= 4 * i) & (F.col("id") < 4 * i + 4)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_stream_running_price(spark, fills, tmp_path):
    out = drain(streaming.running_price(stream(spark, fills, tmp_path), "o", "t", "id", "quantity", "price"), "prices", "append")
    batch = flows.sequence(flows.running_vwap(fills, ["o"], ["t", "id"], "quantity", "price"), ["o"], ["t", "id"])
    key = lambda r: (r[0], r[1], round(r[2], 6), round(r[3], 6))
    assert sorted(map(key, out.select("key", "seq", "filled_quantity", "average_price").collect())) == sorted(map(key, batch.select("o", "seq", "filled_quantity", "average_price").collect()))


def test_stream_buckets(spark, fills, tmp_path):
    out = drain(streaming.bucket_counts(stream(spark, fills, tmp_path), "t", 10, value="quantity"), "buckets", "complete")
    want = fills.groupBy(F.window("t", "10 minutes")["start"].alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("total"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_last_before_and_within(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, "a", 7)], "i int, k string, t int").withColumn("t", F.timestamp_seconds("t"))
    right = spark.createDataFrame([("a", 2, 10), ("a", 5, 20), ("c", 1, 30)], "k string, t int, v int").withColumn("t", F.timestamp_seconds("t"))
    got = flows.last_before(left, right, ["k"], "t", ["v"], {"v": "seen"}).select("i", "seen").collect()
    assert sorted(map(tuple, got)) == [(1, 20), (2, None), (3, None), (4, 20)]
    spans = right.select("k", "v", F.col("t").alias("s"), (F.col("t") + F.expr("INTERVAL 4 SECONDS")).alias("e"))
    for width in (1, 2, 3, 100):
        got = flows.within(left, spans, ["k"], "t", "s", "e", width).select("i", "v").collect()
        assert sorted(map(tuple, got)) == [(1, 10), (1, 20), (4, 20)]
    assert flows.within(left, spans.where("false"), ["k"], "t", "s", "e", 2).columns == ["i", "k", "t", "v", "s", "e"]
