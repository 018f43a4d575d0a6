"""CSV, TSV, JSON and Parquet files, and rows in memory, as typed tables."""

from __future__ import annotations

import re
from collections.abc import Iterable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn

SAMPLE = 100
#: Text forms read as moments, by length 8 to 35.
DATES = r"^(\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?|\d{2}[/-]\d{2}[/-]\d{4}( \d{2}:\d{2}:\d{2})?|\d{4}/\d{2}/\d{2})$"
KINDS = ("boolean", "integer", "float", "datetime", "string")


def table_name(path: str) -> str:
    """The file's stem, other signs as _; `data` if that is long or mostly underscores."""
    name = re.sub(r"[^A-Za-z0-9]", "_", PurePosixPath(path).stem)
    return "data" if not name or len(name) > 30 or name.count("_") > 5 else name


def _tests(c: Column) -> dict[str, Column]:
    integer = c.rlike(r"^[+-]?\d+$") & c.try_cast("bigint").isNotNull()
    return {
        "boolean": F.lower(c).isin("true", "false"),
        "integer": integer,
        "float": c.try_cast("double").isNotNull(),
        "datetime": F.length(c).between(8, 35) & c.rlike(DATES),
    }


def merge_kinds(kinds: set[str]) -> str:
    """One kind for a column: integers and floats are floats; other mixtures, and no values, text."""
    if kinds <= {"integer", "float"} and kinds:
        return "float" if "float" in kinds else "integer"
    return next(iter(kinds)) if len(kinds) == 1 else "string"


def infer(df: DataFrame, sample: int | None = SAMPLE) -> dict[str, str]:
    """The kind of each text column, by one aggregation over the sample (None: all rows)."""
    rows = df if sample is None else df.limit(sample)
    parts = []
    for i, c in enumerate(df.columns):
        col = F.col("`" + c.replace("`", "``") + "`")
        rest = col.isNotNull()
        for kind, test in _tests(col).items():
            parts.append(F.max(F.when(rest & test, 1)).alias(f"{i}_{kind}"))
            rest = rest & ~test
        parts.append(F.max(F.when(rest, 1)).alias(f"{i}_string"))
    found = rows.agg(*parts).first()
    return {c: merge_kinds({k for k in KINDS if found[f"{i}_{k}"]}) for i, c in enumerate(df.columns)}


def typed(c: Column, kind: str) -> Column:
    if kind == "boolean":
        return F.when(F.lower(c).isin("true", "1", "yes"), True).when(F.lower(c).isin("false", "0", "no"), False)
    if kind == "datetime":
        # The common form by the strict reader, others as they can be read.
        return F.coalesce(fn.moment(c), c.try_cast("timestamp_ntz"), F.try_to_timestamp(c, F.lit("MM/dd/yyyy")).cast("timestamp_ntz"))
    return {"integer": c.try_cast("bigint"), "float": c.try_cast("double")}.get(kind, c)


def apply_types(df: DataFrame, kinds: dict[str, str], check: bool = True) -> DataFrame:
    """Typed columns; with `check`, one pass over all rows turns a column back to text if a value beyond the sample doesn't fit."""
    quote = lambda c: F.col("`" + c.replace("`", "``") + "`")
    some = [c for c in df.columns if kinds.get(c, "string") != "string"]
    if check and some:
        bad = df.agg(*[F.max(F.when(quote(c).isNotNull() & typed(quote(c), kinds[c]).isNull(), 1)).alias(f"c{i}") for i, c in enumerate(some)]).first()
        kinds = kinds | {c: "string" for i, c in enumerate(some) if bad[f"c{i}"]}
    return df.select(*[typed(quote(c), kinds.get(c, "string")).alias(c) for c in df.columns])


def _breaks(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field spans lines: the line on which one starts has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).limit(1).isEmpty()


def read_csv(spark: SparkSession, path: str, sep: str = ",", sample: int | None = SAMPLE, check: bool = True, text_null: bool = True, numbers_as_double: bool = False, multi_line: bool | None = None) -> DataFrame:
    """A CSV file with a header. Empty fields, and the text `null` in any case if `text_null`, are NULL.

    Every record must have as many fields as the header, or reading fails. Files are split
    over tasks unless fields hold line breaks: `multi_line` says so; None looks for them in one pass.
    """
    multi_line = _breaks(spark, path) if multi_line is None else multi_line
    head = spark.read.csv(path, header=True, sep=sep, inferSchema=False, quote='"', escape='"', multiLine=multi_line)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in head.columns])
    df = spark.read.csv(path, schema=schema, header=True, sep=sep, quote='"', escape='"', multiLine=multi_line, mode="FAILFAST", nullValue="")
    quote = lambda c: F.col("`" + c.replace("`", "``") + "`")
    if text_null:
        df = df.select(*[F.when(F.lower(quote(c)) != "null", quote(c)).alias(c) for c in df.columns])
    kinds = infer(df, sample)
    if numbers_as_double:
        kinds = {c: "float" if k in ("integer", "float") else "string" for c, k in kinds.items()}
    return apply_types(df, kinds, check)


def _flat(df: DataFrame) -> DataFrame:
    """Nested values as JSON text."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[(F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields])


def _one_value(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file is an array, or one object over several lines, by its first line."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S"))
    first = lines.select(F.col("value").rlike(r"^\s*\[").alias("array"), F.get_json_object("value", "$").isNull().alias("part")).first()
    return first is None or first["array"] or first["part"]


def read_json(spark: SparkSession, path: str, first_object_columns: bool = False, order: list[str] | None = None) -> DataFrame:
    """An array of objects (read by one task), or one object a line: columns of all objects, missing ones NULL."""
    df = _flat(spark.read.json(path, multiLine=_one_value(spark, path)))
    if first_object_columns:
        first = df.limit(1).collect()
        df = df.select(*[f"`{c}`" for c in df.columns if first and first[0][c] is not None])
    return df.select(*[f"`{c}`" for c in order]) if order else df


def from_rows(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """Objects in memory; scalars become a column `value`. Columns are the union of the keys, in order of appearance."""
    import json

    rows = [r if isinstance(r, dict) else {"value": r} for r in rows]
    names = list(dict.fromkeys(k for r in rows for k in r))
    if not names:
        return spark.createDataFrame([], T.StructType([]))

    def kind(values: list) -> T.DataType:
        kinds = {type(v) for v in values if v is not None}
        if kinds == {bool}:
            return T.BooleanType()
        if kinds == {int}:
            return T.LongType()
        if kinds and kinds <= {int, float}:
            return T.DoubleType()
        return T.StringType()

    types = {n: kind([r.get(n) for r in rows]) for n in names}

    def cell(v, t):
        if v is None:
            return None
        if isinstance(t, T.DoubleType):
            return float(v)
        if isinstance(t, T.StringType) and not isinstance(v, str):
            return json.dumps(v)
        return v

    schema = T.StructType([T.StructField(n, types[n]) for n in names])
    return spark.createDataFrame([tuple(cell(r.get(n), types[n]) for n in names) for r in rows], schema)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """By the file's extension."""
    kind = PurePosixPath(path).suffix.lower().lstrip(".")
    readers = {
        "csv": lambda: read_csv(spark, path, **options), "tsv": lambda: read_csv(spark, path, sep="\t", **options),
        "json": lambda: read_json(spark, path, **options), "parquet": lambda: spark.read.parquet(path),
    }
    if kind not in readers:
        raise ValueError(f"Can't read '.{kind}' files; use {', '.join(readers)}")
    return readers[kind]()
