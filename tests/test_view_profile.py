import pytest
from pyspark.sql import functions as F

from tessera.operators import profile, view
from tessera.operators.view import View


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "Ann", "derivatives", 2.0), (2, "bob", "FX spot", 10.0), (3, None, "bonds", None), (4, "Cy", "fx", 2.5)]
    return spark.createDataFrame(rows, "id int, name string, book string, price double").persist()


def ids(v):
    return [r["id"] for r in v.df.collect()]


def test_filters(people):
    v = View(people).sort_by("id")
    assert ids(v.filter_text("FX")) == [2, 4]
    assert ids(v.filter_text("FX", fold=False)) == [2]
    assert ids(v.filter_text("fx").filter_text("")) == [1, 2, 3, 4]
    assert ids(v.select("id").filter_text("bonds")) == [3]  # hidden columns count
    assert ids(v.filter_column("NAME", "n")) == [1]
    assert ids(v.filter_fuzzy("bfs")) == [2]
    assert ids(v.filter_fuzzy("'x sp")) == [2]
    assert ids(v.filter_fuzzy("fx", threshold=30)) == [2, 4]
    assert ids(v.filter_regex("^nul+$")) == [3]
    assert ids(v.filter_text("2.5")) == [4] and ids(v.filter_text("10.0")) == []


def test_sort_states(people):
    v = View(people, ordinal="id")
    assert ids(View(people).sort_by("price", ("id", True))) == [3, 1, 4, 2]
    a = v.toggle_sort("name")
    b = a.toggle_sort("name")
    assert (a.order, b.order, b.toggle_sort("name").order) == ((("name", False),), (("name", True),), ())
    assert View(people).sort_by(("name", True)).limit(2, 1).df.count() == 2


def test_columns(people):
    v = View(people)
    assert v.hide("book").columns == ["id", "name", "price"]
    assert v.pin("price").hide("price").columns == ["price", "id", "name", "book"]
    assert v.move_left("id").columns == ["name", "book", "price", "id"]
    assert v.move_right("id").columns == ["name", "id", "book", "price"]
    assert v.pin("book").unpin("book").columns == v.columns
    assert v.hide_all().columns == [] and v.hide_all().unhide_all().columns == v.columns
    assert v.search_columns("R") == ["price"]
    with pytest.raises(ValueError):
        View(people).pin("id").pin("name").pin("book").pin("price").pin("id").numbered().df
    with pytest.raises(KeyError):
        v.hide("nope")


def test_numbers_cells_rows(people):
    v = View(people).sort_by(("id", True)).numbered()
    assert [tuple(r) for r in v.df.select("#", "id").collect()] == [(1, 4), (2, 3), (3, 2), (4, 1)]
    hits = View(people).cells("b", ["id"])
    assert sorted((r["id"], r["column_name"], r["start"]) for r in hits.collect()) == [(2, "name", 0), (3, "book", 0)]
    assert View(people).cells(r"s\w+t", ["id"], regex=True).count() == 1
    both = View(people).cells("2", ["id"])
    assert sorted((r["id"], r["column_name"]) for r in view.first_hits(both, ["id"]).collect()) == [(1, "price"), (2, "id"), (4, "price")]
    assert View(people).sort_by("id").rows(1) == [["1", "Ann", "derivatives", "2"]]
    assert View(people).sort_by("id").values("name") == ["Ann", "bob", "", "Cy"]
    assert View(people).widths() == {"id": 3, "name": 4, "book": 11, "price": 5}


def test_profile(people):
    rows = {r["column"]: r for r in profile.profile(people).collect()}
    assert (rows["name"]["non_null"], rows["name"]["nulls"], rows["name"]["distinct"]) == (3, 1, 3)
    assert (rows["price"]["sum"], rows["price"]["min"], rows["price"]["max"]) == (14.5, 2.0, 10.0)
    assert rows["book"]["max_length"] == 11 and rows["name"]["min_text"] == "Ann"
    assert profile.profile(people, ["id"], approximate=True).first()["distinct"] == 4


def test_median(spark):
    for values in ([5.0], [1.0, 9.0], [3.0, 1.0, 1.0, 1.0], [2.0, 2.0, 4.0, 8.0, 9.0], [None, 1.0, 2.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        want = profile.median(df, "v").first()[0]
        assert profile.exact_quantile_pair(df, "v").first()[0] == want
    assert profile.exact_quantile_pair(spark.createDataFrame([], "v double"), "v").first()[0] is None


def test_frequency_and_types(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "v string")
    assert [tuple(r) for r in profile.value_frequency(df, "v").collect()] == [("a", 2), ("b", 2), (None, 1)]
    kinds = spark.createDataFrame([("1", "x", "2024-01-01"), ("2", "3", "2024-01-02"), ("", None, "")], "a string, b string, c string")
    assert [profile.dominant_type(kinds, c) for c in "abc"] == ["Integer", "Mixed", "DateTime"]
    assert tuple(profile.table_stats(kinds).first()) == (3, 3, 1)


def test_columns_found_in_turn(people):
    v = View(people)
    assert [v.next_column("I"), v.next_column("i", "id"), v.next_column("i", "price"), v.next_column("i", "id", back=True)] == ["id", "price", "id", "price"]
    assert v.next_column("i", back=True) == "price" and v.next_column("zz") is None


def test_generated_column(people):
    v = View(people).generate("double", F.col("price") * 2).where(F.col("double") > 10).sort_by("id")
    assert v.columns[-1] == "double" and all(float(r[-1]) > 10 for r in v.rows())
    with pytest.raises(ValueError):
        v.generate("ID", F.lit(1))


def test_numbers_are_placed_by_pieces(spark):
    rows = spark.range(0, 5000, 1, 7).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(50)))
    df = View(rows).sort_by(("k", True), "id").numbered().df
    assert "Window" not in df._jdf.queryExecution().toString()
    got = [(r["#"], -r["k"], r["id"]) for r in df.collect()]
    assert [g[0] for g in got] == list(range(1, 5001)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
    assert [r["#"] for r in View(rows).sort_by("id").numbered().limit(3, 10).df.collect()] == [11, 12, 13]
    assert View(rows.where("false")).sort_by("id").numbered().df.collect() == []


def test_profile_has_no_expand(people):
    assert "Expand" not in profile.profile(people)._jdf.queryExecution().toString()
    assert profile.profile(people.where("false")).select("total", "non_null", "distinct", "numbers").distinct().collect() == [(0, 0, 0, 0)]
