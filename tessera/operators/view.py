"""Table views: immutable specifications over a source table, compiled to one plan.

``View.df`` applies, in this order: row filter, sort, projection (pinned columns first,
hidden ones left out), row numbers, offset and limit. Filters see every column of the
source, hidden ones too. The source's order is kept by an ordinal column, if it has one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..plans.compiler import kind_of
from .ranks import number_rows

MAX_PINNED = 4
#: Texts that count as empty, in lower case, trimmed.
BLANKS = ("", "null", "nil", "undefined")
WIDTH_MIN, WIDTH_MAX = 3, 50


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def as_text(df: DataFrame, name: str) -> Column:
    """A cell as the text a reader sees; NULL stays NULL."""
    kind = kind_of(df.schema[name].dataType)
    return fn.number_text(quoted(name), kind == "float") if kind in ("int", "float") else quoted(name).cast("string")


def any_cell(df: DataFrame, test, columns: list[str]) -> Column:
    cells = [F.coalesce(test(as_text(df, c)), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, cells, F.lit(False))


def text_filter(df: DataFrame, pattern: str, columns: list[str] | None = None, fold: bool = True) -> Column:
    """Some cell contains the pattern."""
    hit = (lambda c: F.lower(c).contains(pattern.lower())) if fold else (lambda c: c.contains(pattern))
    return any_cell(df, hit, columns or df.columns)


def regex_filter(df: DataFrame, pattern: str, columns: list[str] | None = None) -> Column:
    """Some cell matches; NULL is the text `null`."""
    return any_cell(df, lambda c: F.coalesce(c, F.lit("null")).rlike(pattern), columns or df.columns)


def row_text(df: DataFrame, columns: list[str]) -> Column:
    return F.concat_ws(" ", *[F.coalesce(as_text(df, c), F.lit("")) for c in columns])


def fuzzy_filter(df: DataFrame, pattern: str, columns: list[str] | None = None) -> Column:
    """The row's cells, joined by spaces, hold the letters in order; a leading ' asks for the exact text."""
    text = row_text(df, columns or df.columns)
    return F.lower(text).contains(pattern[1:].lower()) if pattern.startswith("'") else fn.subsequence(text, pattern)


def fuzzy_above(df: DataFrame, pattern: str, threshold: int, columns: list[str] | None = None) -> Column:
    """The best score of a single cell is above the threshold."""
    scores = [F.coalesce(fn.fuzzy_score(as_text(df, c), pattern), F.lit(0)) for c in columns or df.columns]
    return (F.greatest(*scores) if len(scores) > 1 else scores[0]) > threshold


def empty_columns(df: DataFrame, sample: int | None = 1000) -> list[str]:
    """Columns without a non-blank cell in the first `sample` rows (None: in all), found in one pass."""
    if not df.columns:
        return []
    rows = df if sample is None else df.limit(sample)
    full = lambda c: F.max(F.when(quoted(c).isNotNull() & ~F.lower(fn.trim(quoted(c).cast("string"))).isin(*BLANKS), 1))
    found = rows.agg(*[full(c).alias(f"c{i}") for i, c in enumerate(df.columns)], F.count(F.lit(1)).alias("n")).first()
    return [c for i, c in enumerate(df.columns) if found["n"] and found[f"c{i}"] is None]


def cells(df: DataFrame, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row per cell: key, column number, column name, value as text."""
    columns = columns or df.columns
    each = F.array(*[F.struct(F.lit(i).alias("column_index"), F.lit(c).alias("column_name"), as_text(df, c).alias("value")) for i, c in enumerate(columns)])
    return df.select(*[quoted(k) for k in key], F.explode(each).alias("c")).select(*[quoted(k) for k in key], "c.*")


def find_cells(df: DataFrame, pattern: str, key: list[str], columns: list[str] | None = None, fold: bool = True, regex: bool = False) -> DataFrame:
    """Every cell that holds the pattern, with the place of its first match."""
    each = cells(df, key, columns)
    if regex:
        hit = F.regexp_instr("value", F.lit(pattern))
    else:
        hit = F.instr(F.lower("value") if fold else F.col("value"), F.lit(pattern.lower() if fold else pattern))
    return each.withColumn("start", hit - 1).where("start >= 0")


def first_hits(hits: DataFrame, key: list[str]) -> DataFrame:
    """The leftmost hit of each row."""
    names = [c for c in hits.columns if c not in key]
    best = hits.groupBy(*key).agg(F.min(F.struct("column_index", *[c for c in names if c != "column_index"])).alias("h"))
    return best.select(*key, *[F.col(f"h.{c}").alias(c) for c in names])


def widths(df: DataFrame, sample: int | None = 1000) -> dict[str, int]:
    """Display widths: the longest cell or title, between the least and the most."""
    rows = df if sample is None else df.limit(sample)
    found = rows.agg(*[F.max(F.octet_length(as_text(df, c))).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return {c: min(WIDTH_MAX, max(WIDTH_MIN, len(c), found[f"c{i}"] or 0)) for i, c in enumerate(df.columns)}


@dataclass(frozen=True)
class View:
    source: DataFrame
    ordinal: str | None = None
    base: Column | None = None
    text: Column | None = None
    order: tuple[tuple[str, bool], ...] = ()  # name, descending
    shown: tuple[str, ...] | None = None
    pinned: tuple[str, ...] = ()
    number: str | None = None
    most: int | None = None
    skip: int = 0

    # Rows.

    def where(self, condition: Column) -> View:
        return replace(self, base=condition if self.base is None else self.base & condition)

    def filter_text(self, pattern: str, fold: bool = True) -> View:
        """Replaces the text or fuzzy filter there was; an empty pattern clears it."""
        return replace(self, text=text_filter(self.source, pattern, self.fields, fold) if pattern else None)

    def filter_column(self, name: str, pattern: str, fold: bool = True) -> View:
        return replace(self, text=text_filter(self.source, pattern, [self.resolve(name)], fold) if pattern else None)

    def filter_fuzzy(self, pattern: str, threshold: int | None = None) -> View:
        if not pattern:
            return self.clear_filter()
        found = fuzzy_filter(self.source, pattern, self.fields) if threshold is None else fuzzy_above(self.source, pattern, threshold, self.fields)
        return replace(self, text=found)

    def filter_regex(self, pattern: str) -> View:
        return replace(self, text=regex_filter(self.source, pattern, self.fields) if pattern else None)

    def clear_filter(self) -> View:
        return replace(self, text=None)

    def sort_by(self, *keys: str | tuple[str, bool]) -> View:
        pairs = [(k, False) if isinstance(k, str) else k for k in keys]
        return replace(self, order=tuple((self.resolve(n), d) for n, d in pairs))

    def toggle_sort(self, name: str) -> View:
        """Ascending, then descending, then none."""
        name = self.resolve(name)
        now = self.order[0][1] if len(self.order) == 1 and self.order[0][0] == name else None
        return replace(self, order=((name, False),) if now is None else ((name, True),) if not now else ())

    def clear_sort(self) -> View:
        return replace(self, order=())

    def limit(self, most: int | None, skip: int = 0) -> View:
        return replace(self, most=most, skip=skip)

    # Columns.

    @property
    def fields(self) -> list[str]:
        return [c for c in self.source.columns if c != self.ordinal]

    @property
    def columns(self) -> list[str]:
        free = list(self.shown if self.shown is not None else self.fields)
        return [*self.pinned, *[c for c in free if c not in self.pinned]]

    def resolve(self, name: str) -> str:
        for c in self.fields:
            if c.lower() == name.lower():
                return c
        raise KeyError(f"Column '{name}' not found")

    def select(self, *names: str) -> View:
        return replace(self, shown=tuple(self.resolve(n) for n in names))

    def hide(self, *names: str) -> View:
        """Pinned columns can't be hidden."""
        gone = {self.resolve(n) for n in names} - set(self.pinned)
        return replace(self, shown=tuple(c for c in self.columns if c not in gone))

    def hide_all(self) -> View:
        return replace(self, shown=())

    def unhide_all(self) -> View:
        return replace(self, shown=None)

    def hide_empty(self, sample: int | None = 1000) -> View:
        empty = empty_columns(self._rows().select(*map(quoted, self.columns)), sample)
        return self.hide(*empty)

    def move(self, name: str, by: int) -> View:
        """To the left or right among the free columns; from an end to the other."""
        name = self.resolve(name)
        free = [c for c in self.columns if c not in self.pinned]
        if name not in free:
            return self
        to = (free.index(name) + by) % len(free)
        free.remove(name)
        free.insert(to, name)
        return replace(self, shown=tuple(free))

    def move_left(self, name: str) -> View:
        return self.move(name, -1)

    def move_right(self, name: str) -> View:
        return self.move(name, 1)

    def pin(self, name: str) -> View:
        name = self.resolve(name)
        if name in self.pinned:
            return self
        if len(self.pinned) >= MAX_PINNED:
            raise ValueError(f"At most {MAX_PINNED} columns can be pinned")
        return replace(self, pinned=(*self.pinned, name))

    def unpin(self, name: str) -> View:
        return replace(self, pinned=tuple(c for c in self.pinned if c != self.resolve(name)))

    def clear_pins(self) -> View:
        return replace(self, pinned=())

    def search_columns(self, pattern: str) -> list[str]:
        return [c for c in self.columns if pattern.lower() in c.lower()]

    def next_column(self, pattern: str, now: str | None = None, back: bool = False) -> str | None:
        """The column found after (or before) `now`, round the end; the first (or last) one without `now`."""
        found = [self.columns.index(c) for c in self.search_columns(pattern)]
        if not found:
            return None
        if now is None:
            return self.columns[found[-1 if back else 0]]
        at = self.columns.index(self.resolve(now))
        beyond = [i for i in found if (i < at if back else i > at)] or found
        return self.columns[beyond[-1 if back else 0]]

    def generate(self, name: str, value: Column) -> View:
        """A further column at the right, computed from those of the source; filters and sorts see it."""
        if name.lower() in (c.lower() for c in self.source.columns):
            raise ValueError(f"There is a column {name}")
        shown = None if self.shown is None else (*self.shown, name)
        return replace(self, source=self.source.withColumn(name, value), shown=shown)

    def numbered(self, name: str = "#") -> View:
        """A row-number column at the left; the rows need an order: sort keys or an ordinal.
        They are placed when `df` is taken, by one sort over range partitions."""
        return replace(self, number=name)

    # Results.

    def _rows(self) -> DataFrame:
        df = self.source
        for condition in (self.base, self.text):
            df = df if condition is None else df.where(condition)
        return df

    def _keys(self) -> list[Column]:
        keys = [quoted(n).desc() if d else quoted(n).asc() for n, d in self.order]
        return [*keys, quoted(self.ordinal).asc()] if self.ordinal else keys

    @property
    def df(self) -> DataFrame:
        df, keys = self._rows(), self._keys()
        columns = [quoted(c) for c in self.columns]
        if self.number:
            if not keys:
                raise ValueError("Row numbers need sort keys or an ordinal column")
            named = [c for c in df.columns if c in {*self.columns, *[n for n, _ in self.order], self.ordinal}]
            df = df.select(*[quoted(c) for c in named])
            if self.most is not None:  # a page: what comes after it isn't placed
                df = df.orderBy(*keys).limit(self.skip + self.most)
            df = number_rows(df, keys, self.number)
            df, columns = df.orderBy(quoted(self.number)), [quoted(self.number), *columns]
        elif keys and (self.order or self.most is not None or self.skip):
            df = df.orderBy(*keys)
        df = df.select(*columns)
        if self.skip:
            df = df.offset(self.skip)
        return df if self.most is None else df.limit(self.most)

    def cells(self, pattern: str, key: list[str], fold: bool = True, regex: bool = False) -> DataFrame:
        return find_cells(self._rows(), pattern, key, self.columns, fold, regex)

    def rows(self, n: int = 100) -> list[list[str]]:
        """The first rows as text, NULL as ''."""
        df = self.df
        return [["" if x is None else x for x in r] for r in df.select(*[as_text(df, c).alias(c) for c in df.columns]).limit(n).collect()]

    def values(self, name: str, n: int = 100) -> list[str]:
        return [r[0] for r in self.select(name).rows(n)]

    def widths(self) -> dict[str, int]:
        return widths(self.df)


def with_ordinal(df: DataFrame, name: str = "__ord") -> DataFrame:
    """df with a column that follows the order in which its files are read. Compute it once and
    store the table: it numbers partitions as they are planned."""
    return df.withColumn(name, F.monotonically_increasing_id())
