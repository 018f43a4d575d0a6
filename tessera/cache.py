"""Results of queries, kept as Parquet under a hash of the query and of what it was asked of."""

from __future__ import annotations

import hashlib
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX = "key string, query string, source string, rows long, saved timestamp, deleted boolean"


class QueryCache:
    """A folder that Spark can write: results/<key> and index. The index only grows; the last
    entry of a key counts, so that several sessions can write at once. mode: live (never read),
    cached (only read) or hybrid."""

    def __init__(self, folder: str, mode: str = "hybrid"):
        if mode not in ("live", "cached", "hybrid"):
            raise ValueError(f"Unknown cache mode {mode!r}")
        self.folder, self.mode = folder.rstrip("/"), mode

    @staticmethod
    def key(query: str, context: str = "") -> str:
        """context: whatever else the result depends on (table, schema, dialect, date), as text."""
        return hashlib.sha256(f"{query.strip()}\0{context}".encode()).hexdigest()

    def _path(self, key: str) -> str:
        return f"{self.folder}/results/{key}"

    def _note(self, spark: SparkSession, *row) -> None:
        spark.createDataFrame([row], INDEX).coalesce(1).write.mode("append").parquet(f"{self.folder}/index")

    def save(self, df: DataFrame, query: str, source: str = "", context: str = "") -> DataFrame:
        """Write the result and return it as read back."""
        if self.mode == "cached":
            raise KeyError("The result is not in the cache, and the mode is `cached`")
        key, spark = self.key(query, context), df.sparkSession
        df.write.mode("overwrite").parquet(self._path(key))
        out = spark.read.schema(df.schema).parquet(self._path(key))
        self._note(spark, key, query, source, out.count(), datetime.now(timezone.utc), False)
        return out

    def load(self, spark: SparkSession, query: str, context: str = "") -> DataFrame | None:
        if self.mode == "live":
            return None
        key = self.key(query, context)
        known = self.entries(spark).where(F.col("key") == key).limit(1).count()
        return spark.read.parquet(self._path(key)) if known else None

    def entries(self, spark: SparkSession) -> DataFrame:
        try:
            notes = spark.read.schema(INDEX).parquet(f"{self.folder}/index")
        except Exception as e:  # the folder is made by the first save
            if "PATH_NOT_FOUND" not in str(e):
                raise
            notes = spark.createDataFrame([], INDEX)
        last = notes.groupBy("key").agg(F.max_by(F.struct("query", "source", "rows", "saved", "deleted"), "saved").alias("n"))
        return last.where("not n.deleted").select("key", "n.query", "n.source", "n.rows", "n.saved")

    def _drop(self, spark: SparkSession, key: str, query: str) -> None:
        self._note(spark, key, query, "", 0, datetime.now(timezone.utc), True)
        path = spark._jvm.org.apache.hadoop.fs.Path(self._path(key))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def delete(self, spark: SparkSession, query: str) -> None:
        """All results of the query's text, whatever they were asked of, and their files."""
        for r in self.entries(spark).where(F.col("query") == query).select("key").collect():
            self._drop(spark, r["key"], query)

    def clear(self, spark: SparkSession) -> None:
        for r in self.entries(spark).select("key", "query").collect():
            self._drop(spark, r["key"], r["query"])

    def stats(self, spark: SparkSession) -> DataFrame:
        return self.entries(spark).agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
