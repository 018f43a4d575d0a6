import pytest
from pyspark.sql import functions as F

from tessera.cache import QueryCache
from tessera.engine import Engine
from tessera.plans.parser import QueryError


@pytest.fixture(scope="module")
def trades(spark):
    rows = [(1, "ann", 10.0, 5), (2, "bob", 10.0, 7), (3, "ann", 12.5, 1), (4, None, 8.0, None), (5, "bob", 10.0, 9)]
    return spark.createDataFrame(rows, "id int, trader string, price double, quantity int").persist()


@pytest.fixture
def engine(spark, trades):
    return Engine(spark).register("Trades", trades)


def got(df):
    return [tuple(r) for r in df.collect()]


def test_order_limit_offset(engine):
    assert got(engine.sql("SELECT id FROM trades ORDER BY price DESC, quantity DESC LIMIT 3")) == [(3,), (5,), (2,)]
    assert got(engine.sql("SELECT id ORDER BY id OFFSET 3")) == [(4,), (5,)]
    assert got(engine.sql("SELECT TRADER, Id FROM trades ORDER BY trader, id LIMIT 2")) == [(None, 4), ("ann", 1)]
    assert engine.sql("SELECT TRADER, Id FROM trades").columns == ["trader", "id"]


def test_duplicates_and_expressions(engine):
    assert engine.sql("SELECT id, id FROM trades").columns == ["id", "id"]
    assert got(engine.sql("SELECT price * quantity AS amount FROM trades WHERE id = 3")) == [(12.5,)]
    assert got(engine.sql("SELECT DISTINCT trader FROM trades ORDER BY trader DESC")) == [("bob",), ("ann",), (None,)]


def test_groups(engine):
    text = "SELECT trader, COUNT(*) AS n, SUM(quantity) AS q, MAX(price) - MIN(price) AS spread FROM trades GROUP BY trader HAVING COUNT(*) > 1 ORDER BY q DESC"
    assert got(engine.sql(text)) == [("bob", 2, 16, 0.0), ("ann", 2, 6, 2.5)]
    assert got(engine.sql("SELECT COUNT(*) AS n, COUNT(trader) AS t FROM trades")) == [(5, 4)]
    assert got(engine.sql("SELECT trader.ToUpper() AS who, COUNT(*) AS n FROM trades GROUP BY who ORDER BY n DESC, who LIMIT 1")) == [("ANN", 2)]
    with pytest.raises(QueryError):
        engine.sql("SELECT price, COUNT(*) FROM trades GROUP BY trader")


def test_pages(engine):
    assert got(engine.page("SELECT id FROM trades ORDER BY id", skip=1, take=2)) == [(2,), (3,)]
    assert engine.limited("SELECT id FROM trades", 2).count() == 2
    assert engine.limited("SELECT id FROM trades LIMIT 4", 2).count() == 4


def test_full_sql(engine):
    assert got(engine.spark_sql("WITH t AS (SELECT trader, row_number() OVER (PARTITION BY trader ORDER BY id) AS n FROM trades) SELECT count(*) FROM t WHERE n = 1")) == [(3,)]


def test_cache(spark, engine, trades, tmp_path):
    cache = QueryCache(str(tmp_path / "cache"))
    engine.cache = cache
    text = "SELECT id FROM trades WHERE price > 9 ORDER BY id"
    first, second = engine.query(text), engine.query(text)
    assert (first.cached, second.cached) == (False, True)
    assert got(first.df) == got(second.df) and second.count == 4
    assert got(cache.stats(spark)) == [(1, 4)]
    assert not engine.query(text, refresh=True).cached
    cache.delete(spark, text)
    assert cache.load(spark, text) is None
    engine.query(text)
    cache.clear(spark)
    assert got(cache.stats(spark)) == [(0, 0)]
    with pytest.raises(KeyError):
        Engine(spark, cache=QueryCache(str(tmp_path / "other"), "cached")).register("t", trades).query("SELECT id FROM t")


def test_result_hides_empty(spark):
    e = Engine(spark).load_rows([{"a": 1, "b": None}, {"a": 2, "b": " "}])
    r = e.query("SELECT * FROM data", hide_empty=True)
    assert r.df.columns == ["a"] and r.hidden == ("b",) and r.table == "data"


def test_names_in_other_cases(spark):
    e = Engine(spark).load_rows([{"platform_order_id": 1, "tradeDate": "x"}])
    assert e.sql("SELECT platformOrderId, trade_date, TradeDate FROM data").columns == ["platform_order_id", "tradeDate", "tradeDate"]
    assert e.sql("SELECT tradeDate FROM data WHERE PlatformOrderId = 1").count() == 1


def test_cache_knows_what_was_asked(spark, tmp_path):
    """The same text of another dialect, table or registration is another entry."""
    from tessera.plans.dialect import DOCUMENT

    e = Engine(spark, cache=QueryCache(str(tmp_path / "more")))
    e.load_rows([{"a": "x"}, {"a": "X"}], "one")
    text = "SELECT a WHERE a = 'x'"
    assert [e.query(text).count, e.query(text, dialect=DOCUMENT).count] == [2, 1]
    assert e.query(text).cached and e.query(text, dialect=DOCUMENT).cached
    e.load_rows([{"a": "x"}], "two")
    assert e.query(text).count == 1
    e.load_rows([{"a": "x"}] * 3, "one")
    again = e.query(text)
    assert again.count == 3 and not again.cached
    e.cache.clear(spark)
    assert not list((tmp_path / "more" / "results").iterdir())


def test_entry_survives_missing_libraries(monkeypatch):
    """Without a library of the operations for training data the other queries are there."""
    import sys

    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith("tessera.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    found = __spark_entry__.queries()
    assert len(found) > 100 and not any(n.startswith("op") and n[2].isdigit() for n in found)


def test_own_functions(spark, tmp_path):
    e = Engine(spark, cache=QueryCache(str(tmp_path))).load_rows([{"a": "xy"}, {"a": "zz"}])
    e.register_function("last", lambda c: F.right(c, F.lit(1)))
    assert [r[0] for r in e.sql("SELECT LAST(a) AS l FROM data WHERE a = 'xy'").collect()] == ["y"]
    assert not e.query("SELECT LAST(a) AS l FROM data").cached and not e.query("SELECT LAST(a) AS l FROM data").cached
    with pytest.raises(ValueError):
        e.register_function("x", F.upper, "shape")
