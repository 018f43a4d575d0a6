"""Remote sources: a query service over HTTP as a Spark data source, JSON services, databases."""

from __future__ import annotations

import json
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def post(url: str, body: dict) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=60) as answer:
        return json.load(answer)


class QueryService(DataSource):
    """spark.read.format("queryservice").schema(...).option("url", ...).option("select", ...) .load()

    Pages of `take` rows are asked for by `skip`, each in a task of its own, up to `rows` or,
    if that isn't given, the service's `totalCount`. A service that doesn't tell one is read by
    one task, page after page, until a page is short.
    """

    @classmethod
    def name(cls) -> str:
        return "queryservice"

    def schema(self) -> str:
        raise ValueError("Name the schema of the service's rows")

    def reader(self, schema) -> DataSourceReader:
        return _Pages(schema, dict(self.options))


class _Page(InputPartition):
    def __init__(self, skip: int, take: int, on: bool = False):
        self.skip, self.take, self.on = skip, take, on


class _Pages(DataSourceReader):
    fetch = staticmethod(post)

    def __init__(self, schema, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[_Page]:
        take, rows = int(self.options.get("take", 100)), self.options.get("rows")
        if rows is None:
            rows = self._ask(0, 1).get("totalCount")
        if rows is None:
            return [_Page(0, take, True)]
        return [_Page(s, min(take, int(rows) - s)) for s in range(0, int(rows), take)]

    def read(self, partition: _Page):
        skip = partition.skip
        while True:
            rows = self._ask(skip, partition.take).get("data", [])
            for row in rows:
                yield tuple(row.get(f.name) for f in self.schema.fields)
            skip += partition.take
            if not partition.on or len(rows) < partition.take:
                return

    def _ask(self, skip: int, take: int) -> dict:
        body = {"skip": skip, "take": take}
        if self.options.get("select"):
            body["select"] = self.options["select"].split(",")
        for key in ("where", "orderBy"):
            if self.options.get(key.lower()):
                body[key] = self.options[key.lower()]
        return self.fetch(self.options["url"], body)


def jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A database table; filters and columns are pushed down to it."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def flatten_countries(df: DataFrame) -> DataFrame:
    """Country objects (name.common, capital[], region, population, area) as flat rows."""
    return df.select(F.col("name.common").alias("name"), F.col("capital")[0].alias("capital"), "region", "population", "area")


def pivot_rates(df: DataFrame, base: str = "base", rates: str = "rates") -> DataFrame:
    """One row per currency of a map or object of rates."""
    kind = df.schema[rates].dataType
    pairs = F.col(rates) if kind.typeName() == "map" else F.create_map(*[x for f in kind.fields for x in (F.lit(f.name), F.col(f"{rates}.{f.name}").cast("double"))])
    return df.select(F.col(base).alias("base"), F.explode(pairs).alias("currency", "rate"))
