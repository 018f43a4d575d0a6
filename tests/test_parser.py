import pytest

from tessera.plans import ast
from tessera.plans.parser import QueryError, parse, parse_condition


def where(text, flat=False):
    return parse_condition(text, flat)


def test_statement():
    s = parse("select a, \"b c\" from t where a > 1 order by a desc, b limit 5 offset 2;")
    assert [i.body for i in s.items] == [ast.Name("a"), ast.Name("b c", True)]
    assert (s.table, s.limit, s.offset) == ("t", 5, 2)
    assert [(k.body.text, k.descending) for k in s.order] == [("a", True), ("b", False)]


def test_no_from_and_comments():
    assert parse("SELECT * -- all\nWHERE x = 1").table is None


def test_aliases():
    assert [i.alias for i in parse("SELECT a AS x, SUM(b) total, c \"The C\" FROM t").items] == ["x", "total", "The C"]


def test_precedence_and_flat():
    a, b, c = (ast.Compare("=", ast.Name(n), ast.Number("1")) for n in "abc")
    assert where("a = 1 OR b = 1 AND c = 1") == ast.Logic("OR", a, ast.Logic("AND", b, c))
    assert where("a = 1 OR b = 1 AND c = 1", True) == ast.Logic("AND", ast.Logic("OR", a, b), c)
    assert where("(a = 1 OR b = 1) AND c = 1") == ast.Logic("AND", ast.Logic("OR", a, b), c)


def test_predicates():
    x = ast.Name("x")
    assert where("x NOT IN (1, 'a')") == ast.Not(ast.In(x, (ast.Number("1"), ast.Text("a"))))
    assert where("NOT x IN (1)") == ast.Not(ast.In(x, (ast.Number("1"),)))
    assert where("x BETWEEN -1 AND 2.5") == ast.Between(x, ast.Number("-1"), ast.Number("2.5"))
    assert where("x IS NOT NULL") == ast.Not(ast.IsNull(x))
    assert where("x LIKE 'it''s%'") == ast.Like(x, "it's%")
    assert where("x.Trim().StartsWith('q')") == ast.Method(ast.Method(x, "Trim"), "StartsWith", (ast.Text("q"),))
    assert where("x > DateTime(2024, 1, 2)") == ast.Compare(">", x, ast.Moment((2024, 1, 2)))
    assert where("x < DateTime()") == ast.Compare("<", x, ast.Moment())


def test_group_having_case():
    s = parse("SELECT a, COUNT(DISTINCT b) AS n, CASE a WHEN 1 THEN 'x' ELSE 'y' END FROM t GROUP BY a HAVING COUNT(*) > 2")
    assert s.items[1] == ast.Item(ast.Call("COUNT", (ast.Name("b"),), True), "n")
    assert isinstance(s.items[2].body, ast.Case) and s.group == (ast.Name("a"),)
    assert "Call name='COUNT'" in ast.show(s)


@pytest.mark.parametrize(
    "bad",
    ["SELECT", "SELECT a FROM", "SELECT a FROM t WHERE", "SELECT a FROM t WHERE (a = 1", "SELECT a FROM t WHERE a = 1)", "SELECT a FROM t LIMIT x",
     "SELECT a FROM t WHERE a = 1 b", "SELECT a FROM t WHERE a = 'x", "SELECT a WHERE x BETWEEN 1", "SELECT a WHERE DateTime(1)", "SELECT a WHERE a ? 1"],
)
def test_errors(bad):
    with pytest.raises(QueryError):
        parse(bad)
