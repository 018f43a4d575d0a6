"""What the operators of this subpackage share: words, scratch tables, ranks."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; of a null text, none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names, by its setting or by setCheckpointDir. Only
    a session in local mode may name none: then it is a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = named.get() if named.isDefined() else getattr(spark, "_llm_scratch", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = spark._llm_scratch = tempfile.mkdtemp(prefix="llm-scratch-")
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage ends
    here, a lost executor costs nothing, and later plans know the table's size."""
    path = f"{scratch_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Documents of an Arrow batch, at most: whole texts go through Python, and some are long.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_ROWS rows; each is in memory several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def lean(run):
    """A function over Arrow batches that gives its memory back when it has ended: Python
    workers live on, and what one task has used would be missed by the next stage."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return wrapped


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Join condition on equal names in which null equals null."""
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with the 1-based position of each row within its group, whatever the group's size.

    A window over the group would sort a hot group in one task. Here the rows are
    range-partitioned by (group, order); positions are counted within the pieces and
    the pieces' sizes are summed up. Only the sizes, one row per piece and group, meet
    in a window over the group.
    """
    n = shuffle_partitions(df.sparkSession)
    keys = [F.col(g).asc_nulls_last() for g in group]
    pieces = stored(df.repartitionByRange(n, *keys, *order).withColumn("_piece", F.spark_partition_id()))
    before = W.partitionBy(*group).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    sizes = pieces.groupBy(*group, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*group, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = pieces.withColumn("_in", F.row_number().over(W.partitionBy(*group, "_piece").orderBy(*order)))
    sizes = sizes.select(*[F.col(c).alias(f"_r_{c}") for c in sizes.columns])
    cond = F.lit(True)
    for c in [*group, "_piece"]:
        cond = cond & inside[c].eqNullSafe(sizes[f"_r_{c}"])
    return inside.join(sizes, cond).select(*[inside[c] for c in df.columns], (F.col("_in") + F.col("_r__before")).alias(name))


#: Rows of a side that is broadcast, at most; some 16 bytes each.
BROADCAST_ROWS = 500_000


def only(df: DataFrame, ids: DataFrame, column: str, rows: int | None = None) -> DataFrame:
    """The rows of df whose `column` is in ids (one column of the same name, distinct): by
    a broadcast if ids are counted and few, else by a shuffle of both."""
    n = ids.count() if rows is None else rows
    return df.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, column, "left_semi")


def with_sums(rows: DataFrame, sums: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to sums (one row for each value of `keys`, `count` of them in rows), however many rows share a value.

    total: rows at most. Values with more than total / BROADCAST_ROWS rows are fewer than
    BROADCAST_ROWS whatever the data: they are broadcast, and their rows stay where they
    are. What is shuffled has at most that many rows for a value.
    """
    most = max(1000, -(-total // BROADCAST_ROWS))
    hot = sums.where(F.col(count) > most)
    if hot.isEmpty():
        return rows.join(sums, keys, how)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(sums.where(F.col(count) <= most), keys, how)
    return rest.unionByName(rows.join(F.broadcast(hot), keys))


def _joined(batches):
    """(id, label) from all edges: the smallest id of each component is its root."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for b in batches:
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    ids = list(root)
    for i in range(0, len(ids), 10_000):
        some = ids[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(x) for x in some], pa.int64())], ["id", "label"])


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each id of `edges` (a, b: long) can reach.

    Edges that are few, as counted (BROADCAST_ROWS), are joined in one task. Else large-star
    and small-star in turn (Kiveris et al., 2014): every step hangs neighbours on smaller
    ones, and the number of steps grows with the logarithm of a path's length. Each step
    ends in a table in the shared folder, in place of the one before. A hub's neighbours
    stay where they are, see `with_sums`.
    """
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen is None and state[0] <= BROADCAST_ROWS:
            return now.coalesce(1).mapInArrow(_joined, "id long, label long")
        if state == seen:
            return now.select(F.col("a").alias("id"), F.col("b").alias("label")).unionAll(now.select(F.col("b"), F.col("b")).distinct())
        seen = state
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("c")))
        large = stored(with_sums(both, low, ["a"], "c", 2 * state[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low2 = stored(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("c")))
        small = with_sums(large, low2, ["a"], "c", 2 * state[0]).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        then = stored(small.unionAll(low2.select("a", "m")).distinct())
        discard(now, low, large, low2)
        now = then


def labelled_sample(docs: DataFrame, labels: DataFrame, order: list[Column], most_chars: int) -> list:
    """The rows of docs (doc_id, text, ...) with an id in labels (a bounded number of rows), joined to them, on the driver.

    An id with several rows is there once, with the text of the smallest hash. Texts are
    taken whole, in the order given, as long as they have `most_chars` characters together.
    """
    rows = docs.join(F.broadcast(labels), "doc_id")
    names = [c for c in rows.columns if c != "doc_id"]
    rows = stored(rows.groupBy("doc_id").agg(F.min_by(F.struct(*names), F.struct(F.coalesce(F.xxhash64("text"), F.lit(0)), F.to_json(F.struct(*[n for n in names if n != "text"])))).alias("r")).select("doc_id", "r.*"))
    sizes = rows.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).orderBy(*order).collect()
    some, held = [], 0
    for r in sizes:
        held += r["n"]
        if held > most_chars:
            break
        some.append(r["doc_id"])
    if len(some) < len(sizes):
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in some], rows.select("doc_id").schema)), "doc_id", "left_semi")
    return rows.orderBy(*order).collect()
