"""Sinks: files in several formats, and texts for small results."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.view import as_text


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Fields with commas, quotes or line breaks are quoted, quotes doubled."""
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Without quotes; tabs and line breaks inside a cell become spaces."""
    plain = df.select(*[F.regexp_replace(F.coalesce(as_text(df, c), F.lit("")), r"[\t\r\n]", " ").alias(c) for c in df.columns])
    plain.write.mode(mode).csv(path, header=True, sep="\t", quote="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json(df: DataFrame, path: str, mode: str = "overwrite", strings: bool = False) -> None:
    """One object a line; NULL fields are kept. `strings` writes every value as text."""
    rows = df.select(*[as_text(df, c).alias(c) for c in df.columns]) if strings else df
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def selected(df: DataFrame, number: str, rows: list[int]) -> DataFrame:
    """The rows with the numbers asked for, without the number."""
    return df.where(F.col(f"`{number}`").isin(rows)).drop(number)


def csv_text(df: DataFrame, most: int = 10_000) -> str:
    """A result as CSV text; one of more than `most` rows is an error, here and in the other texts."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    for r in _texts(df, most):
        writer.writerow(["" if x is None else x for x in r])
    return out.getvalue()


def tsv_text(df: DataFrame, most: int = 10_000, header: bool = True) -> str:
    rows = ["\t".join("" if x is None else x for x in r) for r in _texts(df, most)]
    return "\n".join(["\t".join(df.columns), *rows] if header else rows)


def json_text(df: DataFrame, most: int = 10_000) -> str:
    rows = df.limit(most + 1).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))
    return json.dumps([json.loads(r[0]) for r in _whole(rows.collect(), most)], indent=2, ensure_ascii=False)


def column_text(df: DataFrame, name: str, most: int = 10_000) -> str:
    return "\n".join("" if r[0] is None else r[0] for r in _texts(df.select(f"`{name}`"), most))


def table_text(df: DataFrame, rows: int = 20) -> str:
    """Rows in a frame of lines, as `show` prints them."""
    return df._show_string(rows, 50, False)


def schema_text(df: DataFrame) -> str:
    return "\n".join(f"{f.name}: {f.dataType.simpleString()}" for f in df.schema.fields)


def _whole(rows: list, most: int) -> list:
    if len(rows) > most:
        raise ValueError(f"The result has more than {most} rows; write it to a file, or limit it")
    return rows


def _texts(df: DataFrame, most: int) -> list:
    return _whole(df.limit(most + 1).select(*[as_text(df, c).alias(c) for c in df.columns]).collect(), most)
