"""The registered queries of the engine, each with the SQL that another engine answers it by."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from . import functions as fn
from .cache import QueryCache
from .engine import Engine
from .operators import flows, profile, ranks, view
from .operators.view import View
from .plans.dialect import DOCUMENT, VIEW, Dialect
from .sources import files, sinks

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


#: Schemas by application and path: a file's footer is read once for all queries.
SCHEMAS: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in SCHEMAS:
        SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(SCHEMAS[key]).parquet(path)


def engine(spark: SparkSession, sf_dir: str, dialect: Dialect = VIEW) -> Engine:
    e = Engine(spark, dialect)
    for t in TABLES:
        e.register(t, lambda t=t: table(spark, sf_dir, t))
    # Customers with and without large orders: a table with NULLs.
    bought = lambda: table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "o_orderkey", "o_orderstatus", "o_totalprice")
    return e.register("bought", bought)


BOUGHT = "(SELECT c_custkey, c_name, o_orderkey, o_orderstatus, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey) AS bought"


def dialect_query(name: str, text: str, oracle: str, dialect: Dialect = VIEW) -> None:
    """A query in the engine's own dialect."""
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir, dialect).sql(text)
    ORACLES[name] = oracle


def frame_query(oracle: str):
    """A query on DataFrames: the decorated function gets a reader of tables."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda n: table(spark, sf_dir, n))
        ORACLES[f.__name__] = oracle
        return f

    return add


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """Full SQL over the engine's tables."""
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir).spark_sql(text)
    ORACLES[name] = oracle or text


q = dialect_query

# Projection and shell.
q("select_star", "SELECT * FROM region", "SELECT * FROM region")
q("select_cols", "SELECT c_name, c_acctbal FROM customer", "SELECT c_name, c_acctbal FROM customer")
q("select_quoted_ci", 'SELECT "C_NAME", c_CustKey FROM customer', "SELECT c_name, c_custkey FROM customer")
q("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
q("filter_unselected", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-urgent'", "SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) = '1-urgent'")

# Comparison.
q("eq_str", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'", DOCUMENT)
q("eq_str_ci", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'r'", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE lower(l_returnflag) = 'r'")
q("ne_str", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'r'", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE lower(l_returnflag) <> 'r'")
q("cmp_str", "SELECT p_partkey FROM part WHERE p_brand >= 'Brand#3' AND p_brand < 'Brand#5'", "SELECT p_partkey FROM part WHERE p_brand >= 'Brand#3' AND p_brand < 'Brand#5'", DOCUMENT)
q("cmp_str_ci", "SELECT p_partkey FROM part WHERE p_brand >= 'BRAND#3'", "SELECT p_partkey FROM part WHERE lower(p_brand) >= 'brand#3'")
q("cmp_int", "SELECT p_partkey, p_size FROM part WHERE p_size > 20 AND p_size != 30", "SELECT p_partkey, p_size FROM part WHERE p_size > 20 AND p_size != 30")
q("cmp_float", "SELECT o_orderkey FROM orders WHERE o_totalprice <= 50000.5", "SELECT o_orderkey FROM orders WHERE o_totalprice <= 50000.5")
q("cmp_negative", "SELECT c_custkey FROM customer WHERE c_acctbal < -100.5", "SELECT c_custkey FROM customer WHERE c_acctbal < -100.5")
q("cmp_columns", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey < l_suppkey", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey < l_suppkey")
q("coerce_num_str", "SELECT o_orderkey FROM orders WHERE o_totalprice > '100000'", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000", DOCUMENT)
q("no_coercion_view", "SELECT o_orderkey FROM orders WHERE o_totalprice > '100000'", "SELECT o_orderkey FROM orders WHERE false")
q("between_num", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
q("between_str", "SELECT c_custkey FROM customer WHERE c_mktsegment BETWEEN 'B' AND 'G'", "SELECT c_custkey FROM customer WHERE c_mktsegment BETWEEN 'B' AND 'G'")
q("in_list", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('building', 'MACHINERY')", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')")
q("in_numbers", "SELECT p_partkey FROM part WHERE p_size IN (1, 2, 40)", "SELECT p_partkey FROM part WHERE p_size IN (1, 2, 40)")
q("not_in_list", "SELECT c_custkey, o_orderkey FROM bought WHERE o_orderstatus NOT IN ('f', 'P')", f"SELECT c_custkey, o_orderkey FROM {BOUGHT} WHERE o_orderstatus IS NULL OR lower(o_orderstatus) NOT IN ('f', 'p')")
q("like_ci", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '_e%M'", "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '_e%M'")
q("like_cs", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'S%'", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'S%'", DOCUMENT)
q("like_number", "SELECT p_partkey FROM part WHERE p_size LIKE '1%'", "SELECT p_partkey FROM part WHERE CAST(p_size AS VARCHAR) LIKE '1%'", DOCUMENT)
q("is_null", "SELECT c_custkey FROM bought WHERE o_orderkey IS NULL", f"SELECT c_custkey FROM {BOUGHT} WHERE o_orderkey IS NULL")
q("is_not_null", "SELECT c_custkey, o_orderkey FROM bought WHERE o_orderstatus IS NOT NULL AND o_totalprice > 450000", f"SELECT c_custkey, o_orderkey FROM {BOUGHT} WHERE o_orderstatus IS NOT NULL AND o_totalprice > 450000")
q("null_ne_document", "SELECT c_custkey, o_orderkey FROM bought WHERE o_orderstatus != 'F'", f"SELECT c_custkey, o_orderkey FROM {BOUGHT} WHERE o_orderstatus != 'F' OR o_orderstatus IS NULL", DOCUMENT)
q("null_ne_view", "SELECT c_custkey, o_orderkey FROM bought WHERE o_orderstatus != 'F'", f"SELECT c_custkey, o_orderkey FROM {BOUGHT} WHERE o_orderstatus != 'F'")

# Logic.
LOGIC = "SELECT l_orderkey, l_linenumber FROM lineitem WHERE "
q("logic_precedence", LOGIC + "l_returnflag = 'R' OR l_linestatus = 'O' AND l_quantity > 45", LOGIC + "l_returnflag = 'R' OR (l_linestatus = 'O' AND l_quantity > 45)")
q("logic_paren", LOGIC + "(l_returnflag = 'R' OR l_linestatus = 'O') AND l_quantity > 45", LOGIC + "(l_returnflag = 'R' OR l_linestatus = 'O') AND l_quantity > 45")
q("logic_flat", LOGIC + "l_returnflag = 'R' OR l_linestatus = 'O' AND l_quantity > 45", LOGIC + "(l_returnflag = 'R' OR l_linestatus = 'O') AND l_quantity > 45", VIEW.but(flat_logic=True))
q("logic_not", "SELECT c_custkey, o_orderkey FROM bought WHERE NOT o_orderstatus = 'F' AND NOT (o_totalprice > 450000)", f"SELECT c_custkey, o_orderkey FROM {BOUGHT} WHERE NOT coalesce(o_orderstatus = 'F', false) AND NOT coalesce(o_totalprice > 450000, false)")

# Methods.
q("contains", "SELECT p_partkey, p_name FROM part WHERE p_name.Contains('RIN')", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'rin')")
q("contains_cs", "SELECT p_partkey, p_name FROM part WHERE p_name.Contains('rin')", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'rin')", DOCUMENT)
q("starts_with", "SELECT p_partkey, p_name FROM part WHERE p_name.StartsWith('SM')", "SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 'sm')")
q("ends_with", "SELECT p_partkey, p_name FROM part WHERE p_name.EndsWith('g')", "SELECT p_partkey, p_name FROM part WHERE ends_with(lower(p_name), 'g')")
q("contains_numeric", "SELECT p_partkey, p_size FROM part WHERE p_size.Contains('4')", "SELECT p_partkey, p_size FROM part WHERE contains(CAST(p_size AS VARCHAR), '4')")
q("length_bytes", "SELECT doc_id FROM documents WHERE text.Length() > 3000", "SELECT doc_id FROM documents WHERE strlen(text) > 3000")
q("length_number", "SELECT o_orderkey FROM orders WHERE o_orderkey.Length() = 3", "SELECT o_orderkey FROM orders WHERE length(CAST(o_orderkey AS VARCHAR)) = 3")
q("index_of", "SELECT p_partkey FROM part WHERE p_name.IndexOf(' ') > 4", "SELECT p_partkey FROM part WHERE instr(p_name, ' ') - 1 > 4")
q("trim_family", "SELECT p_partkey FROM part WHERE p_name.Trim() = 'small ring' OR p_name.TrimStart() = 'LARGE BOLT' OR p_name.TrimEnd() = 'red gear'", "SELECT p_partkey FROM part WHERE lower(trim(p_name)) IN ('small ring', 'large bolt', 'red gear')")
q("to_lower", "SELECT c_custkey FROM customer WHERE c_mktsegment.ToLower() = 'building'", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'", DOCUMENT)
q("to_upper", "SELECT p_partkey FROM part WHERE p_name.ToUpper() > 'M'", "SELECT p_partkey FROM part WHERE upper(p_name) > 'M'", DOCUMENT)
q("null_or_empty", "SELECT c_custkey, c_name FROM bought WHERE o_orderstatus.IsNullOrEmpty()", f"SELECT c_custkey, c_name FROM {BOUGHT} WHERE o_orderstatus IS NULL OR o_orderstatus = ''")
q("chain", "SELECT p_partkey, p_name FROM part WHERE p_name.Trim().ToUpper().StartsWith('S')", "SELECT p_partkey, p_name FROM part WHERE starts_with(upper(trim(p_name)), 'S')")
q("year_month", "SELECT o_orderkey, o_orderdate.Year() AS y, o_orderdate.Month() AS m, o_orderdate.Day() AS d FROM orders WHERE o_orderdate.Year() = 1996", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d FROM orders WHERE year(o_orderdate) = 1996")
q("substring_replace", "SELECT p_partkey, p_name.Substring(0, 3) AS head, p_name.Replace('a', 'o') AS other FROM part", "SELECT p_partkey, substr(p_name, 1, 3) AS head, replace(p_name, 'a', 'o') AS other FROM part")
q("add_days", "SELECT o_orderkey FROM orders WHERE o_orderdate.AddDays(10) >= DateTime(2000, 1, 1)", "SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 10 DAY >= TIMESTAMP '2000-01-01'")

# Moments.
q("date_after", "SELECT o_orderkey FROM orders WHERE o_orderdate > DateTime(1999, 6, 1)", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1999-06-01'")
q("date_range", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN DateTime(1996, 1, 1) AND DateTime(1996, 12, 31)", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
q("date_time", "SELECT event_id FROM events WHERE ts >= DateTime(2024, 1, 10, 12, 30, 15)", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 12:30:15'")
q("date_text", "SELECT event_id FROM events WHERE ts < '2024-01-05T06:00:00Z'", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-05 06:00:00'")

# Order and limits.
q("order_multi", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
q("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
q("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 25", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 25")
q("offset_only", "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 20", "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 20")
q("order_unselected", "SELECT p_name, p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30", "SELECT p_name, p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30")
q("order_nulls_first", "SELECT c_custkey, o_orderkey FROM bought ORDER BY o_orderkey, c_custkey LIMIT 600", f"SELECT c_custkey, o_orderkey FROM {BOUGHT} ORDER BY o_orderkey NULLS FIRST, c_custkey LIMIT 600")
q("complex_filter", "SELECT o_orderkey FROM orders WHERE o_orderpriority.Contains('H') AND o_orderstatus.Contains('o') AND o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey FROM orders WHERE contains(lower(o_orderpriority), 'h') AND contains(lower(o_orderstatus), 'o') AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
QUERIES["page"] = lambda spark, sf_dir: engine(spark, sf_dir).page("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey", skip=200, take=100)
ORACLES["page"] = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey LIMIT 100 OFFSET 200"

# Aggregation in the dialect.
q("group_basic", "SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS qty, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi, ROUND(AVG(l_discount), 6) AS disc FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS qty, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, round(avg(l_discount), 6) AS disc FROM lineitem GROUP BY l_returnflag")
q("group_distinct", "SELECT event_type, COUNT(DISTINCT user_id) AS users FROM events GROUP BY event_type", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
q("group_case", "SELECT l_linestatus, SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned, MAX(CASE WHEN l_discount > 0.05 THEN l_quantity END) AS most FROM lineitem GROUP BY l_linestatus", "SELECT l_linestatus, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned, max(CASE WHEN l_discount > 0.05 THEN l_quantity END) AS most FROM lineitem GROUP BY l_linestatus")
q("group_expr", "SELECT ts.ToString().Substring(0, 13) AS hour, COUNT(*) AS n FROM events GROUP BY hour", "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS n FROM events GROUP BY 1")
q("having", "SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id HAVING COUNT(*) > 60 ORDER BY n DESC, user_id", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 60")
q("group_order_limit", "SELECT l_suppkey, SUM(l_quantity) AS qty FROM lineitem GROUP BY l_suppkey ORDER BY qty DESC, l_suppkey LIMIT 10", "SELECT l_suppkey, sum(l_quantity) AS qty FROM lineitem GROUP BY l_suppkey ORDER BY qty DESC, l_suppkey LIMIT 10")
q("stats_fns", "SELECT p_brand, ROUND(STDDEV(p_retailprice), 4) AS sd, ROUND(VARIANCE(p_retailprice), 3) AS var, MEDIAN(p_size) AS med, PERCENTILE(p_size, 0.5) AS p50, MODE(p_size) AS most FROM part GROUP BY p_brand", "SELECT p_brand, round(stddev(p_retailprice), 4) AS sd, round(variance(p_retailprice), 3) AS var, CAST(median(p_size) AS DOUBLE) AS med, CAST(quantile_cont(p_size, 0.5) AS DOUBLE) AS p50, (SELECT p_size FROM part x WHERE x.p_brand = part.p_brand GROUP BY p_size ORDER BY count(*) DESC, p_size LIMIT 1) AS most FROM part GROUP BY p_brand")

# Expressions.
q("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state FROM orders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state FROM orders")
q("arith_alias", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_quantity % 7 AS rest FROM lineitem WHERE l_quantity * 2 > 60", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_quantity % 7 AS rest FROM lineitem WHERE l_quantity * 2 > 60")
q("concat_round", "SELECT p_partkey, p_brand || '/' || p_type AS label, ROUND(p_retailprice / 7, 2) AS part FROM part", "SELECT p_partkey, p_brand || '/' || p_type AS label, round(p_retailprice / 7, 2) AS part FROM part")
q("math_fns", "SELECT p_partkey, FLOOR(p_retailprice) AS f, CEIL(p_retailprice) AS c, ABS(p_size - 25) AS a, POW(p_size, 2) AS p, ROUND(SQRT(p_size), 6) AS s, MOD(p_size, 5) AS m, GREATEST(p_size, 10) AS g, LEAST(p_size, 10) AS l, ROUND(LN(p_size + 1), 6) AS ln, ROUND(LOG10(p_retailprice), 6) AS lg, ROUND(SIN(p_size), 6) AS si, ROUND(COS(p_size), 6) AS co FROM part", "SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, abs(p_size - 25) AS a, CAST(pow(p_size, 2) AS DOUBLE) AS p, round(sqrt(p_size), 6) AS s, p_size % 5 AS m, greatest(p_size, 10) AS g, least(p_size, 10) AS l, round(ln(p_size + 1), 6) AS ln, round(log10(p_retailprice), 6) AS lg, round(sin(p_size), 6) AS si, round(cos(p_size), 6) AS co FROM part")
q("substr_fn", "SELECT c_custkey, SUBSTR(c_name, 1, 8) AS head, UPPER(c_mktsegment) AS seg FROM customer", "SELECT c_custkey, substr(c_name, 1, 8) AS head, upper(c_mktsegment) AS seg FROM customer")


# Views.
@frame_query("SELECT * FROM nation WHERE contains(lower(concat_ws('|', n_nationkey, n_name, n_regionkey)), 'on_1')")
def text_filter(t):
    return View(t("nation")).filter_text("ON_1").df


@frame_query("SELECT * FROM part WHERE contains(lower(p_type), 'st')")
def text_filter_col(t):
    return View(t("part")).filter_column("P_TYPE", "st").df


@frame_query("SELECT * FROM part WHERE regexp_matches(lower(concat_ws(' ', p_partkey, p_name, p_brand, p_type, p_size)), 's.*r.*g')")
def fuzzy_filter(t):
    part = t("part").drop("p_retailprice")
    return t("part").where(view.fuzzy_filter(part, "srg"))


@frame_query("SELECT * FROM part WHERE contains(lower(p_name), 'small')")
def fuzzy_exact(t):
    return t("part").where(view.fuzzy_filter(t("part"), "'small", ["p_name"]))


@frame_query("SELECT * FROM nation WHERE regexp_matches(n_name, '1[0-5]$') OR regexp_matches(CAST(n_nationkey AS VARCHAR), '1[0-5]$') OR regexp_matches(CAST(n_regionkey AS VARCHAR), '1[0-5]$')")
def regex_filter(t):
    return View(t("nation")).filter_regex("1[0-5]$").df


@frame_query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def hide_empty(t):
    blank = t("supplier").withColumns({"note": F.lit(" "), "extra": F.lit(None).cast("string"), "gone": F.lit("NULL")})
    return View(blank).hide_empty().df


@frame_query("SELECT s_name, s_acctbal, s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 40 OFFSET 5")
def reorder_pin(t):
    v = View(t("supplier")).hide("s_nationkey").pin("s_name").move_right("s_suppkey")
    return v.sort_by(("s_acctbal", True), "s_suppkey").limit(40, 5).df


@frame_query("SELECT CAST(row_number() OVER (ORDER BY n_name, n_nationkey) AS INTEGER) AS \"#\", n_nationkey, n_name, n_regionkey FROM nation")
def row_numbers(t):
    return View(t("nation")).sort_by("n_name", "n_nationkey").numbered().df


CELLS = "SELECT n_nationkey, 0 AS column_index, 'n_nationkey' AS column_name, CAST(n_nationkey AS VARCHAR) AS value FROM nation UNION ALL SELECT n_nationkey, 1, 'n_name', n_name FROM nation UNION ALL SELECT n_nationkey, 2, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation"


@frame_query(f"SELECT *, CAST(instr(value, '1') - 1 AS INTEGER) AS start FROM ({CELLS}) WHERE contains(value, '1')")
def cell_search(t):
    return View(t("nation")).cells("1", ["n_nationkey"])


@frame_query(f"SELECT * FROM (SELECT *, CAST(instr(value, '1') - 1 AS INTEGER) AS start FROM ({CELLS}) WHERE contains(value, '1')) QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY column_index) = 1")
def cell_search_first(t):
    return view.first_hits(View(t("nation")).cells("1", ["n_nationkey"]), ["n_nationkey"])


# Profiles.
def _profile_sql(table: str, cols: dict[str, str]) -> str:
    out = []
    for c, kind in cols.items():
        text = f"nullif(CAST({c} AS VARCHAR), '')"
        number = f"CAST({c} AS DOUBLE)" if kind in ("int", "float") else f"TRY_CAST({c} AS DOUBLE)"
        out.append(
            f'SELECT \'{c}\' AS "column", \'{kind}\' AS type, count(*) AS total, count({text}) AS non_null, count(DISTINCT {text}) AS "distinct", '
            f"min({text}) AS min_text, max({text}) AS max_text, CAST(min(strlen({text})) AS INTEGER) AS min_length, CAST(max(strlen({text})) AS INTEGER) AS max_length, "
            f"count({number}) AS numbers, round(sum({number}), 2) AS sum, round(avg({number}), 6) AS mean, min({number}) AS min, max({number}) AS max, count(*) - count({text}) AS nulls FROM {table}"
        )
    return " UNION ALL ".join(out)


@frame_query(_profile_sql("part", {"p_partkey": "int", "p_size": "int"}))
def profile_numeric(t):
    return profile.profile(t("part"), ["p_partkey", "p_size"]).withColumns({"sum": F.round("sum", 2), "mean": F.round("mean", 6)})


@frame_query(_profile_sql("part", {"p_name": "string", "p_brand": "string"}))
def profile_string(t):
    return profile.profile(t("part"), ["p_name", "p_brand"]).withColumns({"sum": F.round("sum", 2), "mean": F.round("mean", 6)})


@frame_query("SELECT l_suppkey AS value, count(*) AS frequency FROM lineitem GROUP BY l_suppkey ORDER BY frequency DESC, value LIMIT 40")
def value_freq_top40(t):
    return profile.value_frequency(t("lineitem"), "l_suppkey")


@frame_query("SELECT median(o_totalprice) AS median FROM orders")
def median_exact(t):
    return profile.exact_quantile_pair(t("orders"), "o_totalprice")


@frame_query("SELECT median(value) AS median FROM events")
def median_builtin(t):
    return profile.median(t("events"), "value")


@frame_query(f"SELECT count(*) AS rows, 5 AS columns, CAST(count(*) - count(o_orderkey) + count(*) - count(o_orderstatus) + count(*) - count(o_totalprice) AS BIGINT) AS nulls FROM {BOUGHT}")
def table_stats(t):
    bought = t("customer").join(t("orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "o_orderkey", "o_orderstatus", "o_totalprice")
    return profile.table_stats(bought)


# Windows and flows.
EVENTS = "PARTITION BY user_id ORDER BY ts, event_id"


@frame_query(f"SELECT event_id, user_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER ({EVENTS}))) / 6e7, 4) AS gap_minutes FROM events")
def lag_gap_minutes(t):
    return flows.gap_minutes(t("events"), ["user_id"], "ts", ties=["event_id"]).select("event_id", "user_id", F.round("gap_minutes", 4).alias("gap_minutes"))


@frame_query(f"SELECT event_id, user_id, round(sum(value) OVER ({EVENTS} ROWS UNBOUNDED PRECEDING), 4) AS running FROM events")
def running_sum(t):
    return flows.running_sum(t("events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "user_id", F.round("running", 4).alias("running"))


@frame_query("SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS bucket, round(sum(value), 4) AS total, count(*) AS n, round(sum(sum(value)) OVER (ORDER BY time_bucket(INTERVAL 10 MINUTE, ts) ROWS UNBOUNDED PRECEDING), 3) AS running_total FROM events GROUP BY 1")
def sum_of_sum(t):
    return flows.bucket_totals(t("events"), "ts", 10, "value").withColumns({"total": F.round("total", 4), "running_total": F.round("running_total", 3)})


@frame_query("""SELECT l_orderkey, l_linenumber, l_partkey, sum(l_quantity) OVER w AS filled_quantity, sum(l_quantity * round(l_extendedprice * 100)) OVER w / sum(l_quantity) OVER w AS average_price,
sum(l_quantity) OVER (PARTITION BY l_orderkey) - sum(l_quantity) OVER w AS remaining_quantity, sum(l_quantity) OVER w * 100 / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS fill_percentage,
CASE WHEN sum(l_quantity) OVER w = 0 THEN 'NEW' WHEN sum(l_quantity) OVER (PARTITION BY l_orderkey) - sum(l_quantity) OVER w <= 0 THEN 'FILLED' ELSE 'PARTIALLY_FILLED' END AS state
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)""")
def running_vwap(t):
    # Prices in hundredths: whole numbers, whose sums are the same in any order.
    fills = t("lineitem").withColumn("ordered", F.sum("l_quantity").over(W.partitionBy("l_orderkey"))).withColumn("cents", F.round(F.col("l_extendedprice") * 100))
    out = flows.running_vwap(fills, ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"], "l_quantity", "cents", "ordered")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "filled_quantity", "average_price", "remaining_quantity", "fill_percentage", "state")


@frame_query(f"SELECT event_id, user_id, CAST(sum(f) OVER ({EVENTS} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS distinct_so_far FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 THEN 1 ELSE 0 END AS f FROM events)")
def running_distinct(t):
    return flows.running_distinct(t("events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "distinct_so_far")


@frame_query(f"SELECT event_id, user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(t):
    return flows.latest(t("events").select("event_id", "user_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"])


@frame_query(f"SELECT event_id, user_id, CAST(row_number() OVER ({EVENTS}) AS INTEGER) AS seq, count(*) OVER (PARTITION BY user_id) AS \"of\" FROM events")
def seq_total(t):
    return flows.sequence(t("events"), ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "seq", "of")


@frame_query("SELECT event_id, round(value - avg(value) OVER (PARTITION BY event_type), 6) AS off FROM events")
def avg_over(t):
    return flows.off_average(t("events"), "event_type", "value").select("event_id", F.round("off", 6).alias("off"))


@frame_query("SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def bucket_10min(t):
    return t("events").groupBy(flows.buckets(F.col("ts"), 10).alias("bucket"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@frame_query("SELECT event_id, CASE WHEN value >= 95 THEN 'CRITICAL' WHEN value >= 85 THEN 'HIGH' WHEN value >= 70 THEN 'MEDIUM' ELSE 'LOW' END AS urgency FROM events")
def urgency(t):
    return t("events").select("event_id", flows.urgency(F.col("value")).alias("urgency"))


CURVE = [0.1, 0.2, 0.4, 0.2, 0.1]


@frame_query("WITH s AS (SELECT o_orderkey, o_totalprice, slot, CASE slot WHEN 0 THEN 0.1::DOUBLE WHEN 1 THEN 0.2::DOUBLE WHEN 2 THEN 0.4::DOUBLE WHEN 3 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END AS share FROM orders, range(5) AS r(slot)), f AS (SELECT *, floor(o_totalprice * share) AS part FROM s) SELECT o_orderkey, CAST(slot AS INTEGER) AS slot, round(CASE WHEN slot = 4 THEN o_totalprice - sum(CASE WHEN slot < 4 THEN part END) OVER (PARTITION BY o_orderkey) ELSE part END, 4) AS planned FROM f")
def volume_schedule(t):
    return flows.schedule(t("orders"), CURVE, "o_orderkey", "o_totalprice").withColumn("planned", F.round("planned", 4))


@frame_query("SELECT r_regionkey, count(*) AS fills, round(sum(l_quantity), 2) AS quantity, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS average_price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def hierarchy_rollup(t):
    levels = [(t("orders"), "o_orderkey", "l_orderkey"), (t("customer"), "c_custkey", "o_custkey"), (t("nation"), "n_nationkey", "c_nationkey"), (t("region"), "r_regionkey", "n_regionkey")]
    price = F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice")) / F.sum("l_quantity"), 4)
    return flows.roll_up(t("lineitem"), levels, {"fills": F.count(F.lit(1)), "quantity": F.round(F.sum("l_quantity"), 2), "average_price": price})


@frame_query("SELECT a.l_orderkey, a.l_linenumber, b.l_partkey AS next_partkey FROM lineitem a LEFT JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND b.l_quantity > a.l_quantity")
def self_left_join(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return flows.retries(rows, ["l_orderkey"], "l_linenumber", F.col("next_l_quantity") > F.col("l_quantity")).select("l_orderkey", "l_linenumber", F.col("next_l_partkey").alias("next_partkey"))


@frame_query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ON c_custkey = o_custkey")
def parent_lookup(t):
    parents = t("customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return flows.with_parents(t("orders"), parents, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey", "o_totalprice")


@frame_query("SELECT doc_id, length(text) AS chars, strlen(text) AS bytes, instr(lower(text), 'the') - 1 AS first_the FROM documents")
def text_functions(t):
    return t("documents").select("doc_id", F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), fn.index_of(F.col("text"), F.lit("the")).cast("long").alias("first_the"))


# Reports on flows: events stand for what happens to orders, users for venues, types for states.
@frame_query("SELECT e.event_id, p.event_id AS purchase_id, p.value AS purchase FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def asof_join(t):
    bought = t("events").where("event_type = 'purchase'")
    return flows.last_before(t("events"), bought, ["user_id"], "ts", ["event_id"], {"event_id": "purchase_id", "value": "purchase"}).select("event_id", "purchase_id", "purchase")


@frame_query("SELECT e.event_id, p.event_id AS purchase_id FROM events e JOIN events p ON p.event_type = 'purchase' AND e.user_id = p.user_id AND e.ts >= p.ts AND e.ts < p.ts + INTERVAL 90 MINUTE")
def range_join(t):
    spans = t("events").where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("since"), (F.col("ts") + F.expr("INTERVAL 90 MINUTES")).alias("until"))
    return flows.within(t("events"), spans, ["user_id"], "ts", "since", "until", 3600).select("event_id", "purchase_id")


@frame_query("""SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS filled, count(*) FILTER (event_type = 'view') AS partial, count(*) FILTER (event_type = 'signup') AS rejected,
count(*) FILTER (event_type = 'error') AS bad, round(count(*) FILTER (event_type = 'purchase') * 100 / count(*), 6) AS fill_rate, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'FADING' ELSE 'OK' END AS status
FROM events GROUP BY user_id""")
def venue_scorecard(t):
    return flows.scorecard(t("events"), ["user_id"], "event_type", "purchase", {"view": "partial", "signup": "rejected"}, "error").withColumn("fill_rate", F.round("fill_rate", 6))


@frame_query("""SELECT event_id, from_time, ts, round(m, 4) AS gap_minutes, round(f, 4) AS fills_in_period, CASE WHEN f = 0 THEN 'STUCK' WHEN m > 240 THEN 'SLOW' ELSE 'NORMAL' END AS diagnosis
FROM (SELECT event_id, ts, lag(ts) OVER w AS from_time, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 6e7 AS m, value - lag(value) OVER w AS f FROM events WHERE event_type = 'click' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE from_time IS NOT NULL""")
def problem_periods(t):
    out = flows.periods(t("events").where("event_type = 'click'"), ["user_id"], "ts", "value", 240, ["event_id"])
    return out.select("event_id", "from_time", "ts", F.round("gap_minutes", 4).alias("gap_minutes"), F.round("fills_in_period", 4).alias("fills_in_period"), "diagnosis")


@frame_query("""SELECT user_id, last_time, last_filled, 300.0::DOUBLE AS total, round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last_time)) / 6e7, 4) AS minutes_since
FROM (SELECT user_id, max(ts) AS last_time, max(value) AS last_filled FROM events WHERE event_type = 'purchase' GROUP BY user_id) WHERE last_filled < 300 AND epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last_time) > 30 * 6e7""")
def stuck_orders(t):
    fills = t("events").where("event_type = 'purchase'").withColumn("ordered", F.lit(300.0))
    return flows.stuck(fills, ["user_id"], "ts", "value", "ordered", F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")).withColumn("minutes_since", F.round("minutes_since", 4))


@frame_query("SELECT sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS lost, max(l_quantity * 1000) AS ordered, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) * 100 / max(l_quantity * 1000), 6) AS lost_pct FROM lineitem")
def fade_cost(t):
    return flows.lost_share(t("lineitem"), F.col("l_returnflag") == "R", "l_quantity", F.col("l_quantity") * 1000).withColumn("lost_pct", F.round("lost_pct", 6))


@frame_query("""SELECT *, 200.0::DOUBLE - filled AS unfilled, round(filled * 100 / 200, 6) AS fill_rate, CASE WHEN filled * 100 / 200 < 50 THEN 'POOR' WHEN filled * 100 / 200 < 90 THEN 'FAIR' ELSE 'GOOD' END AS quality
FROM (SELECT l_orderkey, 200.0::DOUBLE AS order_size, sum(l_quantity) AS filled, sum(l_quantity * round(l_extendedprice * 100)) / sum(l_quantity) AS vwap, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'O') AS open FROM lineitem GROUP BY 1)""")
def execution_quality(t):
    fills = t("lineitem").withColumns({"ordered": F.lit(200.0), "cents": F.round(F.col("l_extendedprice") * 100)})
    out = flows.execution_report(fills, ["l_orderkey"], "ordered", "l_quantity", "cents", {"returned": F.col("l_returnflag") == "R", "open": F.col("l_linestatus") == "O"})
    return out.withColumn("fill_rate", F.round("fill_rate", 6))


@frame_query("SELECT l_orderkey, sum(l_quantity) AS filled, avg(round(l_extendedprice * 100)) AS average_price, count(DISTINCT l_suppkey) AS venues FROM lineitem GROUP BY 1")
def client_summary(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("filled"), F.avg(F.round(F.col("l_extendedprice") * 100)).alias("average_price"), F.count_distinct("l_suppkey").alias("venues"))


@frame_query("SELECT 'nation' AS name, CAST(sum(16 + strlen(n_name)) AS BIGINT) AS bytes FROM nation")
def memory_figure(t):
    return t("nation").sparkSession.createDataFrame([("nation", profile.memory_size(t("nation").select("n_nationkey", "n_name", "n_regionkey")))], "name string, bytes long")


@frame_query("SELECT p_partkey, p_name, CAST(strlen(p_name) AS INTEGER) AS letters FROM part WHERE strlen(p_name) > 9")
def generated_column(t):
    v = View(t("part")).generate("letters", F.octet_length("p_name"))
    return v.where(F.col("letters") > 9).select("p_partkey", "p_name", "letters").df


q("datediff", "SELECT o_orderkey, DATEDIFF(DateTime(1998, 1, 1), o_orderdate) AS days FROM orders", "SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') AS INTEGER) AS days FROM orders")


def own_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.register_function("initial", lambda c: F.substring(c, 1, 1), "string")
    return e.sql("SELECT INITIAL(n_name) AS letter, COUNT(*) AS n FROM nation GROUP BY INITIAL(n_name)")


QUERIES["own_function"], ORACLES["own_function"] = own_function, "SELECT n_name[1] AS letter, count(*) AS n FROM nation GROUP BY 1"


# Full SQL.
sql_query("rollup_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql_query("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INTEGER) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
sql_query("interval_days", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1997-01-01' + INTERVAL '30' DAY")
sql_query("cte", "WITH big AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey) SELECT c_custkey, n, round(total, 2) AS total FROM big JOIN customer ON c_custkey = o_custkey WHERE n > 3")
sql_query("scalar_subquery", "SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 4) AS above FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
sql_query("alias_filter", "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS amount FROM lineitem) t WHERE amount > 2000000")
sql_query("union_parts", "SELECT n_name AS name FROM nation UNION SELECT r_name AS name FROM region")
sql_query(
    "rank_fns",
    "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS BIGINT) AS dr, "
    "CAST(ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS BIGINT) AS quarter, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS fst FROM orders",
)
sql_query("cube_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql_query("intersect_keys", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier")
sql_query("except_keys", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 49")
sql_query("semi_anti", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
sql_query("json_props", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")

# Sources and sinks: a table is written, read back with its types found again, and must be what it was.
def round_trip(name: str, text: str, oracle: str, write: Callable, read: Callable) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = ranks.scratch_folder(spark)
        write(engine(spark, sf_dir).spark_sql(text), path)
        return read(spark, path)

    QUERIES[name], ORACLES[name] = run, oracle


PADDED = "SELECT p_partkey, concat('  ', p_name, ' ') AS p_name, p_brand, CAST(p_size AS BIGINT) AS p_size FROM part"
NATION = "SELECT CAST(n_nationkey AS {0}) AS n_nationkey, n_name, CAST(n_regionkey AS {0}) AS n_regionkey FROM nation"


def _write_array(df: DataFrame, path: str) -> None:
    df.sparkSession.createDataFrame([(sinks.json_text(df),)], "value string").coalesce(1).write.text(path)


round_trip("csv_file", "SELECT * FROM bought", f"SELECT * FROM {BOUGHT}", sinks.write_csv, lambda s, p: files.read_csv(s, p, sample=None))
round_trip("csv_breaks", "SELECT c_custkey, concat(c_name, ', \"a\"\n', c_mktsegment) AS note FROM customer", "SELECT c_custkey, c_name || ', \"a\"' || chr(10) || c_mktsegment AS note FROM customer", sinks.write_csv, files.read_csv)
round_trip("tsv_file", PADDED, PADDED, sinks.write_tsv, lambda s, p: files.read_csv(s, p, sep="\t"))
round_trip("csv_doubles", "SELECT * FROM nation", NATION.format("DOUBLE"), sinks.write_csv, lambda s, p: files.read_csv(s, p, numbers_as_double=True))
round_trip("json_lines", "SELECT * FROM bought", f"SELECT * FROM {BOUGHT}", sinks.write_json, files.read_json)
round_trip("json_strings", "SELECT * FROM nation", NATION.format("VARCHAR"), lambda df, p: sinks.write_json(df, p, strings=True), files.read_json)
round_trip("json_array", "SELECT * FROM nation", NATION.format("BIGINT"), _write_array, files.read_json)

QUERIES["rows_memory"] = lambda spark, sf_dir: files.from_rows(spark, [{"a": 1, "b": "x"}, {"a": 2, "c": True}, 7])
ORACLES["rows_memory"] = "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'x', CAST(NULL AS BOOLEAN), CAST(NULL AS BIGINT)), (2, NULL, true, NULL), (NULL, NULL, NULL, 7)) AS t(a, b, c, value)"
QUERIES["current_table"] = lambda spark, sf_dir: Engine(spark).load(f"{sf_dir}/nation.parquet").sql("SELECT n_name WHERE n_regionkey = 2")
ORACLES["current_table"] = "SELECT n_name FROM nation WHERE n_regionkey = 2"
QUERIES["limited"] = lambda spark, sf_dir: engine(spark, sf_dir).limited("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey", 25)
ORACLES["limited"] = "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25"


def first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.router.add("region", lambda: table(spark, sf_dir, "nation"), source="later")
    return e.sql("SELECT * FROM REGION")


def cached_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second answer, from the cache; the first had another dialect."""
    e = engine(spark, sf_dir)
    e.cache = QueryCache(ranks.scratch_folder(spark))
    text = "SELECT c_custkey FROM customer WHERE c_mktsegment = 'building'"
    e.query(text, DOCUMENT)
    e.query(text, VIEW)
    found = e.query(text, VIEW)
    assert found.cached
    return found.df


def padded_trims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.register("padded", e.spark_sql(PADDED))
    return e.sql("SELECT p_partkey FROM padded WHERE p_name.Trim() = 'small ring' OR p_name.TrimStart() = 'large bolt ' OR p_name.TrimEnd() = '  red gear' OR p_name = 'blue ring'")


def today_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.today = date(1997, 6, 1)
    return e.sql("SELECT o_orderkey FROM orders WHERE o_orderdate >= DateTime()")


QUERIES |= {f.__name__: f for f in (first_source, cached_result, padded_trims, today_orders)}
ORACLES["first_source"] = "SELECT * FROM region"
ORACLES["cached_result"] = "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"
ORACLES["padded_trims"] = "SELECT p_partkey FROM part WHERE lower(p_name) IN ('small ring', 'large bolt', 'red gear')"
ORACLES["today_orders"] = "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1997-06-01'"


# Views as texts and specifications.
@frame_query("SELECT 'n_nationkey,n_name' || chr(10) || string_agg(n_nationkey || ',' || n_name || chr(10), '' ORDER BY n_name) AS text FROM (SELECT *, row_number() OVER (ORDER BY n_name) AS i FROM nation) WHERE i IN (1, 3, 20)")
def copied_rows(t):
    rows = sinks.selected(View(t("nation")).sort_by("n_name").numbered().df, "#", [1, 3, 20]).select("n_nationkey", "n_name")
    return rows.sparkSession.createDataFrame([(sinks.csv_text(rows),)], "text string")


@frame_query("SELECT * FROM nation")
def filter_cleared(t):
    return View(t("nation")).filter_text("a").clear_filter().df


@frame_query("SELECT * FROM nation ORDER BY n_name DESC LIMIT 5")
def toggled_sort(t):
    return View(t("nation")).toggle_sort("n_name").toggle_sort("n_name").limit(5).df


@frame_query(" UNION ALL ".join(f"SELECT '{c}' AS name, CAST(least(50, greatest(3, {len(c)}, max(strlen(CAST({c} AS VARCHAR))))) AS BIGINT) AS width FROM nation" for c in ("n_nationkey", "n_name", "n_regionkey")))
def column_widths(t):
    return t("nation").sparkSession.createDataFrame(list(view.widths(t("nation"), None).items()), "name string, width long")


@frame_query(f"SELECT CAST(c_custkey AS VARCHAR) AS k, coalesce(o_orderstatus, '') AS status FROM {BOUGHT} ORDER BY c_custkey, o_orderkey NULLS FIRST LIMIT 40 OFFSET 10")
def row_texts(t):
    bought = t("customer").join(t("orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left")
    rows = View(bought).select("c_custkey", "o_orderstatus").sort_by("c_custkey", "o_orderkey").limit(40, 10).rows()
    return bought.sparkSession.createDataFrame(rows, "k string, status string")


@frame_query("SELECT 'n_nationkey' AS name, CASE WHEN 10 * count(*) FILTER (regexp_full_match(CAST(n_nationkey AS VARCHAR), '[+-]?[0-9]+')) > 9 * count(*) THEN 'Integer' ELSE 'Mixed' END AS type FROM nation")
def dominant_types(t):
    return t("nation").sparkSession.createDataFrame([("n_nationkey", profile.dominant_type(t("nation"), "n_nationkey"))], "name string, type string")


names = reduce(lambda a, b: a | {b}, QUERIES, set())
assert names == set(ORACLES)
