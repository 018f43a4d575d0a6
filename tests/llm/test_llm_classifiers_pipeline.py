import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality_classifier, toxicity


@pytest.fixture(scope="module")
def corpus(spark, docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(600):
        lang = "en" if i % 3 else "fr"
        w = [word() for _ in range(rng.randint(5, 60))]
        toxic, junk = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w) + 1), rng.choice(["zzidiot", "zzscum"]) if lang == "en" else "zveq" + word())
        if junk:
            w = [x + rng.choice(["&&&", "%%%", "###"]) for x in w]
        rows.append((i, " ".join(w), "hot" if i % 2 else f"s{i % 8}", lang))
        labels.append((i, int(not junk), int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {x[0]: x for x in labels}


def test_toxicity_learns(docs, corpus):
    rows, labels, truth = corpus
    learn = labels.where("doc_id % 4 != 2")
    got = toxicity.toxicity(docs(rows), learn, most=400).collect()
    held = [r for r in got if r["doc_id"] % 4 == 2]
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    right = sum((r["score"] >= 0.3) == bool(truth[r["doc_id"]][2]) for r in held)
    assert right >= 0.93 * len(held)
    again = toxicity.toxicity(docs(rows, 5), learn, most=400).collect()
    scores = [[r["score"] for r in sorted(x, key=lambda r: r["doc_id"])] for x in (got, again)]
    assert np.allclose(*scores, atol=1e-6)


def test_toxicity_ignores_lang_source_and_id(docs, corpus):
    rows, labels, _ = corpus
    net, limits = toxicity.train(docs(rows).select("doc_id", "text", "lang"), labels, most=200)
    score = lambda r: [x["score"] for x in toxicity.score(docs(r).select("doc_id", "text", "lang"), net, limits).collect()]
    assert score([(1, rows[0][1], "a", "en")]) == score([(77, rows[0][1], "b", None)])


def test_toxicity_learns_from_every_label(docs, corpus, monkeypatch):
    """However small the parts are, all labelled documents count, and several parts learn together."""
    rows, labels, truth = corpus
    learn = labels.where("doc_id % 4 != 2")
    sizes, plain = [], toxicity.Network.warm
    monkeypatch.setattr(toxicity.Network, "warm", lambda self, seen, n: sizes.append(n.copy()) or plain(self, seen, n))
    net, limits = toxicity.train(docs(rows).select("doc_id", "text", "lang"), learn, most=40)
    assert 0.7 * 450 < sizes[0].sum() < 0.9 * 450  # a fifth is for the thresholds
    got = toxicity.score(docs(rows).select("doc_id", "text", "lang"), net, limits).collect()
    score = {bool(y): sorted(r["score"] for r in got if r["doc_id"] % 4 == 2 and truth[r["doc_id"]][2] == y) for y in (0, 1)}
    above = np.searchsorted(score[False], score[True]).mean() / len(score[False])
    assert above >= 0.95


def test_parameters_come_back():
    net, other = toxicity.Network(64, seed=1), toxicity.Network(64, seed=2)
    other.take(net.parameters())
    assert np.array_equal(net.parameters(), other.parameters()) and not np.array_equal(net.parameters(), toxicity.Network(64, seed=2).parameters())


def test_scores_dont_depend_on_neighbours():
    rng = np.random.default_rng(1)
    net = toxicity.Network(buckets=64, seed=1)
    net.embed[:-1] = rng.normal(0, 1, net.embed[:-1].shape)
    parts = np.array([[64] * 5] + [[i % 64] * 5 for i in range(40)])
    texts = [rng.integers(1, 40, n).tolist() for n in (5, 0, 1, 2, 30, 3)]
    together = net.forward(texts, parts)
    assert np.allclose(together, np.concatenate([net.forward([t], parts) for t in texts]), atol=1e-5)


def test_forward_by_plain_loops():
    """Convolution, pooling and the logistic layer's input, place by place; and a long text in chunks."""
    rng = np.random.default_rng(2)
    net = toxicity.Network(buckets=32, seed=3)
    net.embed[:-1] = rng.normal(0, 1, net.embed[:-1].shape)
    parts = np.array([[32] * 5] + [rng.integers(0, 32, 5).tolist() for _ in range(20)])
    for n in (0, 1, 2, 7, 40):
        text = rng.integers(1, 21, n).tolist()
        vectors = [net.embed[parts[t]].mean(0) for t in [*text, 0, 0, 0]]
        z = net.base
        for k, w in enumerate(toxicity.WIDTHS):
            for f in range(net.bias.shape[1]):
                best = max(sum(float(vectors[i + j] @ net.conv[k][j][:, f]) for j in range(w)) for i in range(len(vectors) - w + 1))
                z += max(0.0, best + net.bias[k, f]) * net.out[k, f]
        assert np.allclose(net.forward([text], parts), z, atol=1e-4)
        for chunk in (1, 3, 100):
            assert np.allclose(net.long(text, parts, chunk), z, atol=1e-4)


def test_repeated_labels_have_a_rule(spark, docs, corpus):
    """Of several labels of one id the greatest counts, in whatever order the rows come."""
    rows, labels, _ = corpus
    more = [(i, 1 - q, 1 - t) for i, q, t in labels.limit(40).collect()]
    every = [tuple(r) for r in labels.collect()] + more
    results = []
    for some in (every, every[::-1]):
        frame = spark.createDataFrame(some, labels.schema)
        net, _ = toxicity.train(docs(rows).select("doc_id", "text", "lang"), frame, most=100)
        model, rate = quality_classifier.fit_evidence(docs(rows).select("doc_id", "text"), frame, most=300)
        results.append((net.embed.sum(), model.weights.sum(), rate))
    assert np.allclose(results[0], results[1], rtol=1e-6)
    few = quality_classifier.fit_evidence(docs(rows).select("doc_id", "text"), labels, 300, most_chars=2000)
    assert 0 < few[1] < 1


def test_toxicity_odd(spark, docs, odd, corpus):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs(odd), none).collect()
    assert len(got) == len(odd) and len({r["score"] for r in got}) == 1
    got = toxicity.toxicity(docs(corpus[0] + odd), corpus[1], most=100).collect()
    assert len(got) == len(corpus[0]) + len(odd)
    blank = {r["score"] for r in got if r["doc_id"] in (1, 2, 3) and r["score"] is not None}
    assert blank
    assert toxicity.toxicity(docs([]), none).collect() == []
    assert toxicity.toxicity(docs([]), corpus[1]).collect() == []


def test_calibration():
    y = np.array([0] * 10 + [1] * 10)
    assert toxicity.calibrated(np.r_[np.full(10, 0.5), np.full(10, 0.9)], y, 0.3) > 0.5
    assert toxicity.calibrated(np.r_[np.full(10, 0.1), np.full(10, 0.9)], y, 0.3) == 0.3
    assert toxicity.calibrated(np.array([0.9]), np.array([1]), 0.3) == 0.3


def test_quality_learns_and_pools(docs, corpus):
    rows, labels, truth = corpus
    got = quality_classifier.classify(docs(rows), labels.where("doc_id % 2 = 1"), keep=["text"]).collect()
    assert len(got) == len(rows)
    assert sum(r["kept"] == bool(truth[r["doc_id"]][1]) for r in got) >= 0.98 * len(rows)
    assert {r["doc_id"]: r["row"]["text"] for r in got} == {r[0]: r[1] for r in rows}
    # Posteriors as the formulas have them, by hand.
    learn = [r for r in truth.values() if r[0] % 2]
    rate = min(max(sum(r[1] for r in learn) / len(learn), 0.01), 0.99)
    host, path = {r[0]: r[2] for r in rows}, {r[0]: (r[2], r[3]) for r in rows}
    p = {r["doc_id"]: 1 / (1 + math.exp(-(r["evidence"] + math.log(rate / (1 - rate))))) for r in got}
    overall = sum(p.values()) / len(p)

    def groups(of):
        out = defaultdict(list)
        for i, x in p.items():
            out[of[i]].append(x)
        return out

    def prior(cells):
        n, k = sum(map(len, cells.values())), len(cells)
        inside = overall * (1 - overall)
        spread = sum(len(c) * (sum(c) / len(c) - overall) ** 2 for c in cells.values())
        between = (spread - (k - 1) * inside) / (n - sum(len(c) ** 2 for c in cells.values()) / n)
        return min(max(inside / between - 1 if between > 0 else 1000.0, 2.0), 1000.0)

    hosts, paths = groups(host), groups(path)
    for r in got:
        i = r["doc_id"]
        h = (sum(hosts[host[i]]) - p[i] + prior(hosts) * overall) / (len(hosts[host[i]]) - 1 + prior(hosts))
        q = (sum(paths[path[i]]) - p[i] + prior(paths) * h) / (len(paths[path[i]]) - 1 + prior(paths))
        q = min(max(q, 1e-6), 1 - 1e-6)
        score = 1 / (1 + math.exp(-(r["evidence"] + math.log(q / (1 - q)))))
        assert np.allclose([r["host_posterior"], r["path_posterior"], r["score"]], [h, q, score], atol=1e-5)
        assert r["kept"] == (r["score"] >= 0.5)


def test_shrinking(spark):
    means = spark.createDataFrame([(1000, 0.9), (1000, 0.1)], "n long, mean double")
    assert quality_classifier.strength(means, 0.5) == 2.0  # groups differ: they speak for themselves
    alike = spark.createDataFrame([(1000, 0.5), (1000, 0.5)], "n long, mean double")
    assert quality_classifier.strength(alike, 0.5) == 1000.0  # they don't: the prior is strong


def test_sparse_sites_lean_on_the_prior(spark, docs, corpus):
    rows, labels, _ = corpus
    more = [(5000 + i, rows[7 * i][1], "junkyard", "en") for i in range(40)] + [(6000, "", "junkyard", "en"), (6001, "", "new", "en")]
    got = {r["doc_id"]: r for r in quality_classifier.classify(docs(rows + more), labels).collect()}
    assert got[6000]["path_posterior"] < 0.5 < got[6001]["path_posterior"]
    assert not got[6000]["kept"] and got[6001]["kept"]


def test_quality_odd(spark, docs, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(docs(odd), none).collect()
    assert len(got) == len(odd) and all(r["evidence"] == 0 for r in got)
    assert quality_classifier.classify(docs([]), none).collect() == []
    assert quality_classifier.word_shape("The&&&12") == "Aa&0"
    assert quality_classifier.word_shape("a" * 300) != quality_classifier.word_shape("a" * 300 + "&9")


def test_pipeline_stages(spark, docs, prose, odd, tmp_path):
    import corpus_pipeline as cp

    rows = prose + [(800 + i, "&&& %%% ### " * 20, "junk") for i in range(20)] + [(r[0] + 900 if r[0] else None, *r[1:]) for r in odd]
    sf = str(tmp_path)
    docs(rows).select(*cp.COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i < 800), 0) for i, *_ in rows if i is not None and i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = {}
    for n, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, now, sf)
        out.write.parquet(f"{sf}/{n}")
        before, now = now, spark.read.parquet(f"{sf}/{n}")
        sizes[name] = now.count()
        if n < len(cp.STAGES) - 1:
            assert now.columns == cp.COLUMNS and now.dtypes == before.dtypes
    kept = spark.read.parquet(f"{sf}/0")
    assert kept.where("source = 'junk'").count() == 0 and kept.where("doc_id < 800").count() == len(prose)
    assert sizes["lines"] == sizes["quality"] and sizes["near_duplicates"] < sizes["lines"]
    mixed = Counter(r["doc_id"] for r in spark.read.parquet(f"{sf}/3").select("doc_id").collect())
    assert max(mixed.values()) <= 3 and sizes["tokens"] == sizes["mix"]
    run = sorted(map(str, cp.run(spark, sf).collect()))
    assert run == sorted(map(str, now.collect()))


def test_pipeline_empty(spark, docs, tmp_path):
    import corpus_pipeline as cp

    sf = str(tmp_path)
    docs([]).select(*cp.COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert cp.run(spark, sf).collect() == []


def test_pipeline_stages_defined_cases(spark, docs, tmp_path):
    import corpus_pipeline as cp

    sf = str(tmp_path)
    text = " ".join(f"word{i}" for i in range(60))
    rows = docs([(1, text, "a"), (1, text, "a"), (2, text, "a"), (None, text, "a"), (3, None, "a"), (4, "other words here entirely", "b"), (5, None, "silent")]).select(*cp.COLUMNS)
    rows.withColumns({"copies": F.lit("x"), "kept": F.lit("y"), "row": F.lit(1)}).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    now, ids = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        now = stage(spark, now, sf)
        ids[name] = sorted((r["doc_id"] for r in now.select("doc_id").collect()), key=str)
        if name != "tokens":
            assert now.columns == cp.COLUMNS
    assert ids["near_duplicates"] == [1, 1, 3, 4, 5, None]
    assert {1, 4} <= set(ids["mix"]) and 5 not in ids["mix"] and ids["tokens"] == ids["mix"]
    assert all(n <= 3 * ids["near_duplicates"].count(i) for i, n in Counter(ids["mix"]).items())
