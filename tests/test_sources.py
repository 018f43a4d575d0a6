import json
from datetime import datetime

import pytest

from tessera.engine import Engine
from tessera.sources import files, remote, sinks
from tessera.sources.router import Chain, Router

CSV = 'id,name,price,active,joined,code,big\n1,"a, ""b""",1.5,true,2024-01-15,BQ-123456,1\n2,,2,FALSE,2024-02-01T10:00:00Z,x,2.5\n3,null,1e-3,true,,y,\n'


@pytest.fixture
def csv_path(tmp_path):
    p = tmp_path / "my-trades.csv"
    p.write_text(CSV)
    return str(p)


def test_csv(spark, csv_path):
    df = files.read(spark, csv_path)
    assert [t for _, t in df.dtypes] == ["bigint", "string", "double", "boolean", "timestamp_ntz", "string", "double"]
    rows = df.orderBy("id").collect()
    assert rows[0]["name"] == 'a, "b"' and rows[1]["name"] is None and rows[2]["name"] is None
    assert rows[1]["joined"] == datetime(2024, 2, 1, 10) and rows[2]["price"] == 0.001
    doc = files.read_csv(spark, csv_path, numbers_as_double=True, text_null=False)
    assert dict(doc.dtypes)["id"] == "double" and doc.where("name = 'null'").count() == 1


def test_beyond_the_sample(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b\n" + "1,2\n" * 5 + "x,3\n")
    assert [t for _, t in files.read_csv(spark, str(p), sample=3).dtypes] == ["string", "bigint"]


def test_ragged_rows_fail(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b\n1\n")
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        files.read_csv(spark, str(p)).collect()


def test_json(spark, tmp_path):
    p = tmp_path / "t.json"
    p.write_text(json.dumps([{"a": 1, "n": {"x": [1, 2]}}, {"a": 2, "b": "q"}]))
    df = files.read(spark, str(p))
    assert sorted(df.columns) == ["a", "b", "n"]
    assert {r["n"] for r in df.collect()} == {'{"x":[1,2]}', None}
    assert sorted(files.read_json(spark, str(p), first_object_columns=True).columns) == ["a", "n"]


def test_rows(spark):
    df = files.from_rows(spark, [{"a": 1, "b": True}, {"a": 2.5, "c": [1]}])
    assert df.dtypes == [("a", "double"), ("b", "boolean"), ("c", "string")]
    assert [r["value"] for r in files.from_rows(spark, [1, 2]).collect()] == [1, 2]
    assert files.from_rows(spark, []).columns == []


def test_names_and_dispatch(spark):
    assert files.table_name("/x/my-trades 1.csv") == "my_trades_1"
    assert files.table_name("/x/a_b_c_d_e_f_g.csv") == "data" and files.table_name("/x/" + "a" * 31 + ".csv") == "data"
    with pytest.raises(ValueError, match="xlsx"):
        files.read(spark, "a.xlsx")


@pytest.mark.parametrize(("kinds", "want"), [({"integer"}, "integer"), ({"integer", "float"}, "float"), ({"integer", "string"}, "string"), (set(), "string"), ({"boolean"}, "boolean")])
def test_merge(kinds, want):
    assert files.merge_kinds(kinds) == want


def test_engine_loads(spark, csv_path):
    e = Engine(spark).load(csv_path)
    assert e.current == "my_trades"
    assert e.sql("SELECT id FROM my_trades WHERE active AND price < 1").first()["id"] == 3
    assert e.schema()[0] == ("id", "bigint")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"\nc', None), (2, "x\ty", 2.0)], "n int, s string, v double").coalesce(1)
    sinks.write_csv(df, str(tmp_path / "c"))
    back = spark.read.csv(str(tmp_path / "c"), header=True, multiLine=True, escape='"')
    assert sorted(r["s"] for r in back.collect()) == ['a,"b"\nc', "x\ty"]
    sinks.write_json(df, str(tmp_path / "j"), strings=True)
    assert spark.read.json(str(tmp_path / "j")).where("n = '2' and v = '2'").count() == 1
    sinks.write_tsv(df, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).where("value = '2\tx y\t2'").count() == 1
    assert sinks.csv_text(df).startswith('n,s,v\n1,"a,""b""\nc",\n')
    assert json.loads(sinks.json_text(df))[0] == {"n": 1, "s": 'a,"b"\nc', "v": None}
    assert sinks.tsv_text(df.where("n = 2")) == "n\ts\tv\n2\tx\ty\t2"
    assert sinks.column_text(df, "v") == "\n2" and "n: int" in sinks.schema_text(df)
    assert sinks.selected(df, "n", [2]).count() == 1 and "s" in sinks.table_text(df)


def test_router():
    r = Router()
    r.add("T", lambda: "a")
    r.add("t", lambda: "b", "second")
    r.add("u", lambda: "c", "second")
    assert r.find("t")() == "a" and r.find("U")() == "c" and r.find("v") is None
    assert r.source_of("u") == "second" and r.names() == ["t", "u"]
    chain = Chain((lambda s: s == "x", lambda s: 1), (lambda s: True, lambda s: 2))
    assert chain.run("x") == 1 and chain.run("y") == 2
    with pytest.raises(ValueError):
        Chain().run("z")


def test_query_service_pages(spark):
    schema = files.from_rows(spark, [{"id": 1, "name": "x"}]).schema
    reader = remote.QueryService({"url": "u", "rows": "250", "take": "100", "select": "id,name"}).reader(schema)
    asked = []
    reader.fetch = lambda url, body: asked.append(body) or {"data": [{"id": body["skip"], "name": "n"}]}
    rows = [row for p in reader.partitions() for row in reader.read(p)]
    assert rows == [(0, "n"), (100, "n"), (200, "n")]
    assert asked[2] == {"skip": 200, "take": 50, "select": ["id", "name"]}


def test_public_shapes(spark):
    rates = spark.createDataFrame([("EUR", {"USD": 1.1, "GBP": 0.9})], "base string, rates map<string,double>")
    assert sorted(map(tuple, remote.pivot_rates(rates).collect())) == [("EUR", "GBP", 0.9), ("EUR", "USD", 1.1)]
    land = spark.createDataFrame([((("X",)), ["c"], "r", 5, 1.0)], "name struct<common:string>, capital array<string>, region string, population int, area double")
    assert tuple(remote.flatten_countries(land).first()) == ("X", "c", "r", 5, 1.0)


@pytest.mark.parametrize("total", [250, None])
def test_service_is_read_to_its_end(total):
    """Without `rows` all pages are read, whether or not the service tells how many rows there are."""
    from pyspark.sql import types as T

    def fetch(url, body):
        rows = [{"id": i} for i in range(body["skip"], min(250, body["skip"] + body["take"]))]
        return {"data": rows} | ({"totalCount": total} if total else {})

    reader = remote.QueryService({"url": "u", "take": "100"}).reader(T.StructType([T.StructField("id", T.LongType())]))
    reader.fetch = fetch
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == list(range(250))
    assert len(reader.partitions()) == (3 if total else 1)
