"""Truth tables of the predicates in both presets, plans, and random predicates against an interpreter."""

from datetime import date, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.engine import Engine
from tessera.plans import ast
from tessera.plans.compiler import Compiler
from tessera.plans.dialect import DOCUMENT, VIEW
from tessera.plans.parser import QueryError

SCHEMA = "id int, name string, n int, price double, ok boolean, at timestamp_ntz, day string, `202204` int"
ROWS = [
    (1, "Alice", 30, 19.99, True, datetime(2024, 1, 15), "2024-01-15", 5),
    (2, "bob", 25, 150.0, False, datetime(2024, 6, 1, 12), "2024-06-01T12:00:00Z", 7),
    (3, None, None, None, None, None, None, None),
    (4, "", 0, 0.00001, True, datetime(2025, 1, 1), "2025-01-01 00:00:00", 0),
    (5, "  hé\t", 7, -3.5, False, datetime(2023, 12, 31, 23, 59, 59), "not a date", 12),
    (6, "123", 123, 123.0, True, datetime(2024, 1, 15, 0, 0, 1), "2024-01-15T02:00:00+02:00", 1),
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA).persist()


def ids(spark, frame, condition, dialect=VIEW):
    e = Engine(spark, dialect, today=date(2024, 6, 1)).register("t", frame)
    return sorted(r["id"] for r in e.where(condition).collect())


@pytest.mark.parametrize(
    ("condition", "view", "document"),
    [
        ("name = 'ALICE'", [1], []),
        ("name = 'Alice'", [1], [1]),
        ("name != 'alice'", [2, 4, 5, 6], [1, 2, 3, 4, 5, 6]),
        ("name < 'b'", [1, 4, 5, 6], [1, 4, 5, 6]),
        ("name >= 'B'", [2], [2]),
        ("n = 25", [2], [2]),
        ("n = '25'", [], [2]),
        ("name = 123", [], [6]),
        ("name = '123.0'", [], [6]),
        ("price = 150", [2], [2]),
        ("price > 1e2", [2, 6], [2, 6]),
        ("n BETWEEN 7 AND 30", [1, 2, 5], [1, 2, 5]),
        ("name BETWEEN 'A' AND 'B'", [1], [1]),
        ("name IN ('ALICE', 'bob')", [1, 2], [2]),
        ("name NOT IN ('ALICE', 'bob')", [3, 4, 5, 6], [1, 3, 4, 5, 6]),
        ("NOT n IN (25, 30)", [3, 4, 5, 6], [3, 4, 5, 6]),
        ("name LIKE 'a%'", [1], []),
        ("n LIKE '2%'", [], [2]),
        ("name LIKE 'b_b'", [2], [2]),
        ("name IS NULL", [3], [3]),
        ("name IS NOT NULL AND n > 20", [1, 2, 6], [1, 2, 6]),
        ("NOT n > 20", [3, 4, 5], [3, 4, 5]),
        ("NOT (n > 20 OR ok = true)", [3, 5], [3, 5]),
        ("ok", [1, 4, 6], [1, 4, 6]),
        ("ok = 'true'", [], []),
        ("name.Contains('LI')", [1], []),
        ("name.StartsWith('al')", [1], []),
        ("name.EndsWith('OB')", [2], []),
        ("price.Contains('150.')", [], []),
        ("price.StartsWith('0.00001')", [4], [4]),
        ("name.Length() = 5", [1], [1]),
        ("name.Length() = 6", [5], [5]),
        ("name.Length() = 0", [3, 4], [4]),
        ("n.Length() = 2", [1, 2], []),
        ("name.IndexOf('B') = 0", [2], [2]),
        ("name.IndexOf('z') = -1", [1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6]),
        ("name.Trim() = 'HÉ'", [5], []),
        ("name.TrimStart() = 'hé'", [], []),
        ("name.Trim() = ''", [3, 4], [3, 4]),
        ("name.ToUpper() = 'ALICE'", [1], [1]),
        ("name.IsNullOrEmpty()", [3, 4], [3, 4]),
        ("n.IsNullOrEmpty()", [3], [3]),
        ("name.Trim().ToLower().StartsWith('al')", [1], [1]),
        ("at > DateTime(2024, 1, 15)", [2, 4, 6], [2, 4, 6]),
        ("at < '2024-01-01'", [5], [5]),
        ("day >= DateTime(2024, 6, 1)", [2, 4], [2, 4]),
        ("day = DateTime(2024, 1, 15)", [1, 6], [1, 6]),
        ("at >= DateTime()", [2, 4], [2, 4]),
        ("at BETWEEN DateTime(2024,1,1) AND DateTime(2024,12,31)", [1, 2, 6], [1, 2, 6]),
        ("202204 > 5", [2, 5], [2, 5]),
        ("n > price", [1, 5], [1, 5]),
        ('name = "bob"', [2], [2]),
        ("name = 'Alice' OR n = 7 AND price > 0", [1], [1]),
        ("at.Year() = 2024", [1, 2, 6], [1, 2, 6]),
        ("name.Substring(0, 2) = 'bo'", [2], [2]),
        ("name.Replace('b', 'x') = 'xox'", [2], [2]),
        ("at.AddDays(1) > DateTime(2025, 1, 1)", [4], [4]),
    ],
)
def test_truth(spark, frame, condition, view, document):
    assert ids(spark, frame, condition, VIEW) == view
    assert ids(spark, frame, condition, DOCUMENT) == document


def test_flat_logic(spark, frame):
    condition = "name = 'Alice' OR n = 7 AND price > 0"
    assert ids(spark, frame, condition, VIEW.but(flat_logic=True)) == [1]
    assert ids(spark, frame, "price > 0 OR n = 7 AND ok", VIEW.but(flat_logic=True)) == [1, 4, 6]
    assert ids(spark, frame, "n = 7 OR price > 0 AND ok", VIEW) == [1, 4, 5, 6]


@pytest.mark.parametrize("bad", ["nope = 1", "name.Nope()", "n.Contains()", "FOO(n) > 1", "n + 1", "x > DateTime(2024, 13, 1)"])
def test_unresolved(spark, frame, bad):
    with pytest.raises(QueryError):
        ids(spark, frame, bad)


def test_unknown_table(spark):
    with pytest.raises(QueryError):
        Engine(spark).sql("SELECT * FROM nowhere")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pushdown(spark):
    e = Engine(spark, DOCUMENT).load("/root/testdata/sf0.001/lineitem.parquet", "lineitem")
    plan = _plan(e.sql("SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > '10'"))
    assert "EqualTo(l_returnflag,R)" in plan and "GreaterThan(l_quantity,10.0)" in plan
    assert "l_comment" not in plan and "l_tax" not in plan.split("ReadSchema")[1]
    plan = _plan(e.sql("SELECT l_orderkey FROM lineitem WHERE l_returnflag.StartsWith('R')"))
    assert "StringStartsWith(l_returnflag,R)" in plan
    plan = _plan(e.sql("SELECT l_orderkey FROM lineitem ORDER BY l_quantity DESC, l_orderkey LIMIT 5"))
    assert "TakeOrderedAndProject" in plan


# Random predicates against a small interpreter of the two-valued logic.
VALUES = {"a": [None, "x", "Y", "xy", "12"], "i": [None, -1, 0, 12]}
GRID = [(a, i) for a in VALUES["a"] for i in VALUES["i"]]
leaf = st.one_of(
    st.builds(lambda op, v: ("cmp", op, "a", v), st.sampled_from(["=", "!=", "<", ">="]), st.sampled_from(["x", "y", "XY"])),
    st.builds(lambda op, v: ("cmp", op, "i", v), st.sampled_from(["=", "!=", "<", ">="]), st.sampled_from([0, 12])),
    st.builds(lambda c: ("null", c), st.sampled_from(["a", "i"])),
    st.builds(lambda v: ("contains", v), st.sampled_from(["x", "Y", "2"])),
    st.builds(lambda v: ("in", v), st.sampled_from([["x"], ["Y", "12"]])),
)
tree = st.recursive(leaf, lambda t: st.one_of(st.builds(lambda x: ("not", x), t), st.builds(lambda o, x, y: (o, x, y), st.sampled_from(["AND", "OR"]), t, t)), max_leaves=6)


def to_ast(t):
    if t[0] == "cmp":
        return ast.Compare(t[1], ast.Name(t[2]), ast.Number(str(t[3])) if t[2] == "i" else ast.Text(t[3]))
    if t[0] == "null":
        return ast.IsNull(ast.Name(t[1]))
    if t[0] == "contains":
        return ast.Method(ast.Name("a"), "Contains", (ast.Text(t[1]),))
    if t[0] == "in":
        return ast.In(ast.Name("a"), tuple(map(ast.Text, t[1])))
    return ast.Not(to_ast(t[1])) if t[0] == "not" else ast.Logic(t[0], to_ast(t[1]), to_ast(t[2]))


def truth(t, row, d):
    if t[0] == "cmp":
        x, y = row[t[2]], t[3]
        if x is None:
            return t[1] == "!=" and d.null_ne_is_true
        if t[2] == "a" and d.case_insensitive and (t[1] in ("=", "!=") or d.fold_order):
            x, y = x.lower(), y.lower()
        return {"=": x == y, "!=": x != y, "<": x < y, ">=": x >= y}[t[1]]
    if t[0] == "null":
        return row[t[1]] is None
    if t[0] == "contains":
        return row["a"] is not None and (t[1].lower() in row["a"].lower() if d.methods_fold else t[1] in row["a"])
    if t[0] == "in":
        return row["a"] is not None and (row["a"].lower() in [v.lower() for v in t[1]] if d.case_insensitive else row["a"] in t[1])
    if t[0] == "not":
        return not truth(t[1], row, d)
    pair = truth(t[1], row, d), truth(t[2], row, d)
    return all(pair) if t[0] == "AND" else any(pair)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(trees=st.lists(tree, min_size=20, max_size=20))
def test_random_logic(spark, trees):
    df = spark.createDataFrame([(k, a, i) for k, (a, i) in enumerate(GRID)], "k int, a string, i int").coalesce(1)
    for d in (VIEW, DOCUMENT):
        c = Compiler(df, d)
        out = df.orderBy("k").select(*[c.predicate(to_ast(t), True).alias(f"p{j}") for j, t in enumerate(trees)]).collect()
        want = [[truth(t, {"a": a, "i": i}, d) for t in trees] for a, i in GRID]
        assert [list(r) for r in out] == want
