"""From the syntax tree to DataFrames and Columns.

Logic is two-valued: a predicate on NULL is false, and its negation true. A leaf is
wrapped in coalesce(leaf, false) only beneath NOT (or where its value is shown), so that a
plain filter stays a bare comparison that Parquet can take. Case-sensitive comparisons
are emitted without functions on the column for the same reason, and literals, not
columns, are cast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn
from . import ast
from .dialect import VIEW, Dialect
from .parser import QueryError

STRING, INT, FLOAT, BOOL, TIME, NULL, OTHER = "string", "int", "float", "bool", "time", "null", "other"
NUMERIC = (INT, FLOAT)
#: Kinds that a function may return.
KINDS = (STRING, INT, FLOAT, BOOL, TIME)


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.StringType | T.CharType | T.VarcharType):
        return STRING
    if isinstance(t, T.IntegralType):
        return INT
    if isinstance(t, T.FractionalType):
        return FLOAT
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType):
        return TIME
    return NULL if isinstance(t, T.NullType) else OTHER


@dataclass(frozen=True)
class Value:
    """A compiled expression; `literal` holds a constant's Python value. never: a predicate on it is false."""

    col: Column
    kind: str
    literal: object = None
    constant: bool = False
    never: bool = False

    def text(self) -> Column:
        """As the text that methods see."""
        if self.kind == STRING:
            return self.col
        return fn.number_text(self.col, self.kind == FLOAT) if self.kind in NUMERIC else self.col.cast("string")


def constant(x) -> Value:
    if x is None:
        return Value(F.lit(None), NULL, None, True)
    kinds = {bool: BOOL, int: INT, float: FLOAT, str: STRING, datetime: TIME}
    col = F.lit(x).cast("timestamp_ntz") if isinstance(x, datetime) else F.lit(x)
    return Value(col, kinds[type(x)], x, True)


def _number(text: str) -> float | None:
    try:
        x = float(text.strip())
    except ValueError:
        return None
    return x if math.isfinite(x) else None


AGGREGATES = {
    "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "STDDEV": F.stddev, "VARIANCE": F.variance,
    "MEDIAN": F.median, "MODE": lambda c: F.mode(c, True),
}
SCALARS = {
    "ABS": F.abs, "FLOOR": F.floor, "CEIL": F.ceil, "POW": F.pow, "POWER": F.pow, "SQRT": F.sqrt, "GREATEST": F.greatest,
    "LEAST": F.least, "SIN": F.sin, "COS": F.cos, "TAN": F.tan, "LN": F.ln, "LOG": F.ln, "LOG10": F.log10, "EXP": F.exp,
    "UPPER": F.upper, "LOWER": F.lower, "COALESCE": F.coalesce, "CONCAT": F.concat, "YEAR": F.year, "MONTH": F.month, "DAY": F.day,
}
TEXT_RESULTS = {"UPPER", "LOWER", "CONCAT", "SUBSTR", "SUBSTRING", "REPLACE"}
INT_RESULTS = {"FLOOR", "CEIL", "YEAR", "MONTH", "DAY", "DATEDIFF"}


class Compiler:
    def __init__(self, df: DataFrame, dialect: Dialect = VIEW, today: date | None = None, functions: dict | None = None):
        self.df, self.dialect, self.today, self.functions = df, dialect, today, functions or {}
        self.fields: dict[str, T.StructField] = {}
        for f in df.schema.fields:
            self.fields.setdefault(f.name.lower(), f)
        # The same name in camel or snake case, where it is one column's only.
        loose: dict[str, list[T.StructField]] = {}
        for f in self.fields.values():
            loose.setdefault(_loose(f.name), []).append(f)
        self.loose = {k: v[0] for k, v in loose.items() if len(v) == 1}

    # Names and values.

    def field(self, name: str) -> T.StructField | None:
        return self.fields.get(name.lower()) or (self.loose.get(_loose(name)) if "_" in name or name != name.lower() else None)

    def column(self, name: str) -> Value:
        f = self.field(name)
        if f is None:
            raise QueryError(f"Column '{name}' not found; the table has {', '.join(x.name for x in self.fields.values())}")
        return Value(F.col("`" + f.name.replace("`", "``") + "`"), kind_of(f.dataType))

    def value(self, node: ast.Node) -> Value:
        if isinstance(node, ast.Name):
            if self.field(node.text) is None:
                if node.text.lower() in ("true", "false") and not node.quoted:
                    return constant(node.text.lower() == "true")
                if node.quoted:
                    return constant(node.text)
            return self.column(node.text)
        if isinstance(node, ast.Number):
            return self.column(node.raw) if self.field(node.raw) else constant(node.value)
        if isinstance(node, ast.Text):
            return constant(node.value)
        if isinstance(node, ast.Null):
            return constant(None)
        if isinstance(node, ast.Moment):
            return self.moment(node)
        if isinstance(node, ast.Method):
            return self.method(node)
        if isinstance(node, ast.Negate):
            body = self.value(node.body)
            return Value(-body.col, body.kind)
        if isinstance(node, ast.Arith):
            return self.arith(node)
        if isinstance(node, ast.Case):
            return self.case(node)
        if isinstance(node, ast.Call):
            return self.call(node)
        return Value(self.predicate(node, True), BOOL)

    def moment(self, node: ast.Moment) -> Value:
        if not node.parts:
            if self.today is not None:
                return constant(datetime(self.today.year, self.today.month, self.today.day))
            return Value(F.current_date().cast("timestamp_ntz"), TIME)
        try:
            return constant(datetime(*node.parts))
        except ValueError as e:
            raise QueryError(f"DateTime: {e}") from e

    def arith(self, node: ast.Arith) -> Value:
        left, right = self.value(node.left), self.value(node.right)
        if node.op == "||":
            return Value(F.concat(left.text(), right.text()), STRING)
        a, b = left.col, right.col
        whole = left.kind == right.kind == INT
        if node.op == "/":
            return Value(F.try_divide(a, b), FLOAT)
        if node.op == "%":
            return Value(F.try_mod(a, b), INT if whole else FLOAT)
        return Value({"+": a + b, "-": a - b, "*": a * b}[node.op], INT if whole else FLOAT)

    def case(self, node: ast.Case) -> Value:
        out, kind = None, NULL
        for when, then in node.whens:
            test = self.predicate(when if node.subject is None else ast.Compare("=", node.subject, when), False)
            v = self.value(then)
            kind = v.kind if kind == NULL else kind
            out = F.when(test, v.col) if out is None else out.when(test, v.col)
        if node.otherwise is not None:
            v = self.value(node.otherwise)
            kind = v.kind if kind == NULL else kind
            out = out.otherwise(v.col)
        return Value(out, kind)

    def call(self, node: ast.Call) -> Value:
        name = node.name
        if name == "COUNT":
            if node.args and isinstance(node.args[0], ast.Star):
                return Value(F.count(F.lit(1)), INT)
            cols = [self.value(a).col for a in node.args]
            return Value(F.count_distinct(*cols) if node.distinct else F.count(cols[0]), INT)
        args = [self.value(a) for a in node.args]
        cols = [a.col for a in args]
        if name in self.functions:
            own, kind = self.functions[name]
            return Value(own(*cols), kind)
        if name in AGGREGATES:
            if len(cols) != 1:
                raise QueryError(f"{name} needs one argument")
            kind = args[0].kind if name in ("SUM", "MIN", "MAX", "MODE") else FLOAT
            return Value(F.sum_distinct(cols[0]) if node.distinct and name == "SUM" else AGGREGATES[name](cols[0]), kind)
        if name == "PERCENTILE":
            return Value(F.percentile(cols[0], cols[1]), FLOAT)
        if name == "ROUND":
            return Value(F.round(cols[0], int(args[1].literal) if len(args) > 1 else 0), args[0].kind)
        if name == "MOD":
            return Value(F.try_mod(*cols), args[0].kind)
        if name in ("SUBSTR", "SUBSTRING"):
            return Value(F.substr(args[0].text(), *cols[1:]), STRING)
        if name == "REPLACE":
            return Value(F.replace(args[0].text(), *cols[1:]), STRING)
        if name == "DATEDIFF":
            return Value(F.datediff(*cols), INT)
        if name not in SCALARS:
            raise QueryError(f"Unknown function {name}")
        if name == "CONCAT":
            cols = [a.text() for a in args]
        kind = STRING if name in TEXT_RESULTS else INT if name in INT_RESULTS else args[0].kind if name in ("ABS", "GREATEST", "LEAST", "COALESCE") else FLOAT
        return Value(SCALARS[name](*cols), kind)

    # Methods.

    def method(self, node: ast.Method) -> Value:
        body, name = self.value(node.body), node.name.lower()
        args = [self.argument(a) for a in node.args]

        def take(n: int, most: int | None = None):
            if not n <= len(args) <= (most or n):
                raise QueryError(f"{node.name} needs {n} argument{'s' * (n != 1)}")

        if name in ("contains", "startswith", "endswith"):
            take(1)
            return self.search(body, name, args[0])
        if name == "length":
            take(0)
            if body.kind == STRING:
                # A missing text has length 0 in the one dialect, and no length in the other.
                n = F.octet_length(body.col)
                return Value(F.coalesce(n, F.lit(0)) if self.dialect.length_of_numbers else n, INT)
            if not self.dialect.length_of_numbers:
                return Value(F.lit(None).cast("int"), INT, never=True)
            return Value(F.coalesce(F.octet_length(body.text()), F.lit(0)) if body.kind in NUMERIC else F.lit(0), INT)
        if name == "indexof":
            take(1)
            return Value(fn.index_of(body.text(), args[0].text()), INT)
        if name in ("trim", "trimstart", "trimend"):
            take(0)
            return Value(fn.trim(body.text(), name != "trimend", name != "trimstart"), STRING)
        if name in ("tolower", "toupper"):
            take(0)
            return Value((F.lower if name == "tolower" else F.upper)(body.text()), STRING)
        if name == "isnullorempty":
            take(0)
            empty = body.col == "" if body.kind == STRING else F.lit(False)
            return Value(body.col.isNull() | F.coalesce(empty, F.lit(False)), BOOL)
        if name == "substring":
            take(1, 2)
            start = args[0].col + 1  # 0-based
            return Value(F.substr(body.text(), start, args[1].col) if len(args) > 1 else F.substr(body.text(), start), STRING)
        if name == "replace":
            take(2)
            return Value(F.replace(body.text(), args[0].col, args[1].col), STRING)
        if name == "tostring":
            take(0)
            return Value(body.text(), STRING)
        if name in ("year", "month", "day"):
            take(0)
            return Value({"year": F.year, "month": F.month, "day": F.day}[name](self.time(body)), INT)
        if name == "adddays":
            take(1)
            return Value(self.time(body) + F.make_dt_interval(args[0].col.cast("int")), TIME)
        raise QueryError(f"Unknown method {node.name}")

    def argument(self, node: ast.Node) -> Value:
        """A quoted name inside a method is text, in either kind of quotes."""
        return constant(node.text) if isinstance(node, ast.Name) and node.quoted else self.value(node)

    def time(self, v: Value) -> Column:
        return fn.moment(v.col) if v.kind == STRING else v.col.cast("timestamp_ntz")

    def search(self, body: Value, name: str, what: Value) -> Value:
        fold = self.dialect.methods_fold and body.kind == STRING
        text, x = body.text(), what.text()
        if fold:
            text = F.lower(text)
            x = F.lit(what.literal.lower()) if isinstance(what.literal, str) else F.lower(x)
        return Value({"contains": text.contains, "startswith": text.startswith, "endswith": text.endswith}[name](x), BOOL)

    # Predicates.

    def predicate(self, node: ast.Node, exact: bool) -> Column:
        """exact: the value must be true or false; else NULL may stand for false."""
        if isinstance(node, ast.Logic):
            left, right = self.predicate(node.left, exact), self.predicate(node.right, exact)
            return left & right if node.op == "AND" else left | right
        if isinstance(node, ast.Not):
            return ~self.predicate(node.body, True)
        if isinstance(node, ast.IsNull):
            return self.value(node.body).col.isNull()
        if isinstance(node, ast.Compare):
            found = self.compare(node.op, self.value(node.left), self.value(node.right))
        elif isinstance(node, ast.Between):
            v = self.value(node.body)
            low, high = self.value(node.low), self.value(node.high)
            found = self.compare(">=", v, low, fold=False) & self.compare("<=", v, high, fold=False)
        elif isinstance(node, ast.In):
            found = self.member(self.value(node.body), [self.value(i) for i in node.items])
        elif isinstance(node, ast.Like):
            found = self.like(self.value(node.body), node.pattern)
        else:
            v = self.value(node)
            if v.kind != BOOL:
                raise QueryError("A condition is expected")
            found = v.col
        return F.coalesce(found, F.lit(False)) if exact else found

    def compare(self, op: str, left: Value, right: Value, fold: bool = True) -> Column:
        d, no = self.dialect, F.lit(False)
        if left.constant and not right.constant:
            return self.compare({"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op), right, left, fold)
        if left.never or right.never or NULL in (left.kind, right.kind):
            return no
        a, b = left.col, right.col
        if TIME in (left.kind, right.kind):
            found = self.moments(op, left, right)
        elif left.kind in NUMERIC and right.kind in NUMERIC:
            found = _op(op, a, b)
        elif left.kind == right.kind == STRING:
            if d.coerce_text_numbers and isinstance(right.literal, str) and (x := _number(right.literal)) is not None:
                n = a.try_cast("double")
                found = F.when(n.isNotNull() & ~n.isin(math.inf, -math.inf) & ~F.isnan(n), _op(op, n, F.lit(x))).otherwise(_op(op, a, b))
            else:
                if fold and d.case_insensitive and (op in ("=", "!=") or d.fold_order):
                    a = F.lower(a)
                    b = F.lit(right.literal.lower()) if isinstance(right.literal, str) else F.lower(b)
                found = _op(op, a, b)
        elif {left.kind, right.kind} <= {STRING, *NUMERIC}:
            found = self.coerced(op, left, right)
        elif left.kind == right.kind:
            found = _op(op, a, b)
        else:
            found = no
        return F.coalesce(found, F.lit(True)) if op == "!=" and d.null_ne_is_true else found

    def coerced(self, op: str, left: Value, right: Value) -> Column:
        """A number with text: by value if the text holds a number, else false."""
        if not self.dialect.coerce_text_numbers:
            return F.lit(False)
        if isinstance(right.literal, str):
            x = _number(right.literal)
            # The literal is cast, so that the column can be compared in the scan.
            return F.lit(False) if x is None else _op(op, left.col, F.lit(int(x) if left.kind == INT and x.is_integer() else x))
        num = lambda v: v.col if v.kind in NUMERIC else v.col.try_cast("double")
        return _op(op, num(left), num(right))

    def moments(self, op: str, left: Value, right: Value) -> Column:
        side = lambda v: _as_moment(v) if v.kind in (TIME, STRING) else None
        a, b = side(left), side(right)
        return F.lit(False) if a is None or b is None else _op(op, a, b)

    def member(self, v: Value, items: list[Value]) -> Column:
        if v.kind in NUMERIC and all(i.constant and i.kind in NUMERIC for i in items):
            return v.col.isin([i.literal for i in items])
        if v.kind == STRING and all(isinstance(i.literal, str) for i in items):
            if self.dialect.case_insensitive:
                return F.lower(v.col).isin([i.literal.lower() for i in items])
            return v.col.isin([i.literal for i in items])
        found = F.lit(False)
        for i in items:
            # Lists compare strictly typed values: text with text, numbers with numbers.
            if v.kind == i.kind or {v.kind, i.kind} <= set(NUMERIC) or TIME in (v.kind, i.kind):
                found = found | F.coalesce(self.compare("=", v, i), F.lit(False))
        return F.when(v.col.isNull(), F.lit(False)).otherwise(found)

    def like(self, v: Value, pattern: str) -> Column:
        if v.kind != STRING and not (self.dialect.like_stringify and v.kind in (*NUMERIC, BOOL)):
            return F.lit(False)
        escaped = pattern.replace("\\", "\\\\")
        return v.text().ilike(escaped) if self.dialect.like_fold else v.text().like(escaped)

    # Statements.

    def select(self, node: ast.Select) -> DataFrame:
        df = self.df
        if node.where is not None:
            df = df.where(self.predicate(node.where, False))
        if node.group or any(_aggregated(i.body) for i in node.items) or node.having is not None:
            return self.grouped(df, node)
        keys = [self.key(k, node) for k in node.order]
        columns = [c for item in node.items for c in self.projected(item)]
        if node.distinct:
            df = df.select(*columns).distinct()
            if keys:
                df = df.orderBy(*[k for k in self.output_keys(df, node)])
        else:
            df = (df.orderBy(*keys) if keys else df).select(*columns)
        return self.cut(df, node)

    def cut(self, df: DataFrame, node: ast.Select) -> DataFrame:
        if node.offset:
            df = df.offset(node.offset)
        return df if node.limit is None else df.limit(node.limit)

    def projected(self, item: ast.Item) -> list[Column]:
        if isinstance(item.body, ast.Star):
            return [F.col("`" + f.name.replace("`", "``") + "`") for f in self.df.schema.fields]
        v = self.value(item.body)
        return [v.col.alias(self.title(item))]

    def title(self, item: ast.Item) -> str:
        if item.alias:
            return item.alias
        body = item.body
        name = body.text if isinstance(body, ast.Name) else body.raw if isinstance(body, ast.Number) else None
        if name is not None and (f := self.field(name)):
            return f.name  # the table's spelling
        return _words(body)

    def key(self, k: ast.Key, node: ast.Select) -> Column:
        body = k.body
        if isinstance(body, ast.Name) and self.field(body.text) is None:
            for item in node.items:
                if item.alias and item.alias.lower() == body.text.lower():
                    body = item.body
        v = self.column(body.text) if isinstance(body, ast.Name) else self.value(body)
        return v.col.desc() if k.descending else v.col.asc()

    def output_keys(self, df: DataFrame, node: ast.Select) -> list[Column]:
        own = Compiler(df, self.dialect, self.today)
        out = []
        for k in node.order:
            title = next((self.title(i) for i in node.items if i.body == k.body or isinstance(k.body, ast.Name) and (i.alias or "").lower() == k.body.text.lower()), None)
            v = own.column(title) if title else own.column(k.body.text if isinstance(k.body, ast.Name) else _words(k.body))
            out.append(v.col.desc() if k.descending else v.col.asc())
        return out

    def grouped(self, df: DataFrame, node: ast.Select) -> DataFrame:
        aliases = {i.alias.lower(): i.body for i in node.items if i.alias}
        bodies = [aliases.get(g.text.lower(), g) if isinstance(g, ast.Name) and self.field(g.text) is None else g for g in node.group]
        keys = [self.value(b).col.alias(f"__k{i}") for i, b in enumerate(bodies)]
        found: dict[ast.Node, str] = {}

        def replaced(n: ast.Node) -> ast.Node:
            """Group keys and aggregates as names of the aggregated table."""
            if n in bodies:
                return ast.Name(f"__k{bodies.index(n)}")
            if isinstance(n, ast.Name) and self.field(n.text) is None and n.text.lower() in aliases and aliases[n.text.lower()] is not n:
                return replaced(aliases[n.text.lower()])
            if isinstance(n, ast.Call) and (n.name in AGGREGATES or n.name in ("COUNT", "PERCENTILE")):
                return ast.Name(found.setdefault(n, f"__a{len(found)}"))
            if isinstance(n, ast.Name) and not n.quoted and self.field(n.text) is not None:
                same = [i for i, b in enumerate(bodies) if isinstance(b, ast.Name) and b.text.lower() == n.text.lower()]
                if not same:
                    raise QueryError(f"Column '{n.text}' is neither grouped nor aggregated")
                return ast.Name(f"__k{same[0]}")
            return _mapped(n, replaced)

        items = [ast.Item(replaced(i.body), self.title(i)) for i in node.items if not isinstance(i.body, ast.Star)]
        having = replaced(node.having) if node.having is not None else None
        order = [ast.Key(replaced(k.body), k.descending) for k in node.order]
        sums = [self.call(c).col.alias(name) for c, name in found.items()] or [F.count(F.lit(1)).alias("__a0")]
        out = Compiler(df.groupBy(*keys).agg(*sums), self.dialect, self.today)
        return out.select(ast.Select(tuple(items), None, having, order=tuple(order), limit=node.limit, offset=node.offset, distinct=node.distinct))


def _loose(name: str) -> str:
    return name.replace("_", "").lower()


def _op(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _as_moment(v: Value) -> Column | None:
    if isinstance(v.literal, str):
        found = fn.parse_moment(v.literal)
        return None if found is None else F.lit(found).cast("timestamp_ntz")
    return fn.moment(v.col) if v.kind == STRING else v.col


def _aggregated(n) -> bool:
    if isinstance(n, tuple):
        return any(map(_aggregated, n))
    if isinstance(n, ast.Call) and (n.name in AGGREGATES or n.name in ("COUNT", "PERCENTILE")):
        return True
    return isinstance(n, ast.Node) and any(_aggregated(getattr(n, k)) for k in n.__dataclass_fields__)


def _mapped(n, f):
    """The node with f applied to the nodes below it."""
    if isinstance(n, tuple):
        return tuple(f(x) if isinstance(x, ast.Node) else _mapped(x, f) for x in n)
    if not isinstance(n, ast.Node):
        return n
    below = {k: getattr(n, k) for k in n.__dataclass_fields__}
    return type(n)(**{k: f(v) if isinstance(v, ast.Node) else _mapped(v, f) if isinstance(v, tuple) else v for k, v in below.items()})


def _words(n: ast.Node) -> str:
    """A title for an expression without alias."""
    if isinstance(n, ast.Call):
        return f"{n.name.lower()}({', '.join(map(_words, n.args))})"
    if isinstance(n, ast.Name):
        return n.text
    if isinstance(n, ast.Number):
        return n.raw
    if isinstance(n, ast.Star):
        return "*"
    if isinstance(n, ast.Text):
        return n.value
    if isinstance(n, ast.Arith):
        return f"{_words(n.left)} {n.op} {_words(n.right)}"
    if isinstance(n, ast.Method):
        return f"{_words(n.body)}.{n.name}({', '.join(map(_words, n.args))})"
    return type(n).__name__.lower()
