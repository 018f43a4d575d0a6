"""The engine: a catalog of tables, and queries on them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession

from .cache import QueryCache
from .operators.view import View, empty_columns
from .plans import ast
from .plans.compiler import KINDS, Compiler
from .plans.dialect import VIEW, Dialect
from .plans.parser import QueryError, parse, parse_condition
from .sources import files
from .sources.router import Router


@dataclass(frozen=True)
class Result:
    """A query's rows, and where they come from. The count is taken when it is asked for."""

    df: DataFrame
    query: str
    source: str
    table: str
    cached: bool = False
    hidden: tuple[str, ...] = ()

    @property
    def count(self) -> int:
        return self.df.count()


class Engine:
    """Tables by name, in any case; a query without FROM reads the table loaded last."""

    def __init__(self, spark: SparkSession, dialect: Dialect = VIEW, today: date | None = None, cache: QueryCache | None = None):
        self.spark, self.dialect, self.today, self.cache = spark, dialect, today, cache
        self.router = Router()
        self.current: str | None = None
        self.registered: dict[str, int] = {}  # how often each name has been given to a table
        self.functions: dict[str, tuple[Callable, str]] = {}

    # Tables.

    def register(self, name: str, df: DataFrame | Callable[[], DataFrame]) -> Engine:
        self.router.add(name, df if callable(df) else lambda: df)
        self.registered[name.lower()] = self.registered.get(name.lower(), 0) + 1
        self.current = name
        return self

    def register_function(self, name: str, function: Callable[..., Column], kind: str = "string") -> Engine:
        """A function of columns, by its name in any case; kind of its results: string, int, float, bool or time.

        It is an expression, built once per query. A pandas UDF is one as well. In `spark_sql`,
        functions are those that the session has.
        """
        if kind not in KINDS:
            raise ValueError(f"Unknown kind {kind}")
        self.functions[name.upper()] = (function, kind)
        return self

    def _compiler(self, df: DataFrame, dialect: Dialect) -> Compiler:
        return Compiler(df, dialect, self.today, self.functions)

    def load(self, path: str, name: str | None = None, **options) -> Engine:
        """A CSV, TSV, JSON or Parquet file; the name of the table follows the file's."""
        return self.register(name or files.table_name(path), files.read(self.spark, path, **options))

    def load_csv(self, path: str, name: str | None = None, **options) -> Engine:
        return self.register(name or files.table_name(path), files.read_csv(self.spark, path, **options))

    def load_json(self, path: str, name: str | None = None, **options) -> Engine:
        return self.register(name or files.table_name(path), files.read_json(self.spark, path, **options))

    def load_rows(self, rows: Iterable[dict], name: str = "data") -> Engine:
        return self.register(name, files.from_rows(self.spark, rows))

    def table(self, name: str | None = None) -> DataFrame:
        name = name or self.current
        if name is None:
            raise QueryError("No table is loaded")
        found = self.router.find(name)
        if found is None:
            raise QueryError(f"Table '{name}' not found; there are {', '.join(sorted(self.router.names())) or 'none'}")
        return found()

    def schema(self, name: str | None = None) -> list[tuple[str, str]]:
        return [(f.name, f.dataType.simpleString()) for f in self.table(name).schema.fields]

    # Queries.

    def sql(self, query: str, dialect: Dialect | None = None) -> DataFrame:
        d = dialect or self.dialect
        node = parse(query, d.flat_logic)
        return self._compiler(self.table(node.table), d).select(node)

    def where(self, condition: str, table: str | None = None, dialect: Dialect | None = None) -> DataFrame:
        d = dialect or self.dialect
        df = self.table(table)
        return df.where(self._compiler(df, d).predicate(parse_condition(condition, d.flat_logic), False))

    def query(self, query: str, dialect: Dialect | None = None, hide_empty: bool = False, refresh: bool = False) -> Result:
        """The rows with their origin; from the cache, if there is one and it has them."""
        d = dialect or self.dialect
        node = parse(query, d.flat_logic)
        name = node.table or self.current or ""
        table = self.table(node.table)
        # The same text is another query for another table, registration, schema, dialect or day.
        context = repr((name.lower(), self.registered.get(name.lower(), 0), table.schema.simpleString(), d, self.today or date.today()))
        cache = None if self.functions else self.cache  # a text says nothing about what an own function does
        cached = cache.load(self.spark, query, context) if cache is not None and not refresh else None
        df = cached if cached is not None else self._compiler(table, d).select(node)
        if cache is not None and cached is None:
            df = cache.save(df, query, name, context)
        hidden = tuple(empty_columns(df)) if hide_empty else ()
        return Result(df.drop(*hidden) if hidden else df, query, "cache" if cached is not None else "table", name, cached is not None, hidden)

    def page(self, query: str, skip: int = 0, take: int = 100, dialect: Dialect | None = None) -> DataFrame:
        """Rows `skip` to `skip + take`: filter, order, skip, take, project."""
        d = dialect or self.dialect
        node = parse(query, d.flat_logic)
        node = ast.Select(node.items, node.table, node.where, node.group, node.having, node.order, take, node.offset + skip, node.distinct)
        return self._compiler(self.table(node.table), d).select(node)

    def limited(self, query: str, most: int = 1000) -> DataFrame:
        """With a limit of `most` rows unless the query has its own."""
        d = self.dialect
        node = parse(query, d.flat_logic)
        return self.page(query, 0, most if node.limit is None else node.limit)

    def explain(self, query: str) -> str:
        return ast.show(parse(query, self.dialect.flat_logic))

    def view(self, name: str | None = None) -> View:
        return View(self.table(name))

    def spark_sql(self, query: str) -> DataFrame:
        """Full Spark SQL (joins, windows, CTEs) over the same tables; only those that the text names are opened."""
        words = set(re.findall(r"\w+", query.lower()))
        for name in self.router.names():
            if words >= set(re.findall(r"\w+", name.lower())):
                self.router.find(name)().createOrReplaceTempView(name)
        return self.spark.sql(query)
