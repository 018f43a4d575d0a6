import random
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import _shared, line_dedup, near_dedup


def brute_lines(rows):
    """(id, text) -> the lines that are left, as lists; documents in order of id."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        lines = t.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if not re.search(r"[^\x20\x09-\x0D]", "".join(w)):
                continue
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        out[i] = (len(lines), sorted(gone), "\n".join(x for p, x in enumerate(lines) if p not in gone))
    return out


def spans(gone):
    out = []
    for p in gone:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return ",".join(f"{a}-{b}" for a, b in out)


def test_lines(docs, prose):
    rows = prose + [(500, "q\nq\nq\nq\nq\nw"), (501, "a\n\n\n\nb"), (502, "\n\n\n\n\n"), (503, "x\ny\nz"), (504, "0\nx\ny\nz\n1\nx\ny\nz\ny\nz")]
    want = brute_lines(rows)
    got = line_dedup.dedup_lines(docs(rows), columns=["source", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        n, gone, text = want[r["doc_id"]]
        assert (r["n_lines"], r["n_removed"], r["removed"], r["text"]) == (n, len(gone), spans(gone), text)
        assert r["row"]["text"] == dict(rows)[r["doc_id"]]


def test_lines_odd(docs, odd):
    got = line_dedup.dedup_lines(docs(odd)).collect()
    assert len(got) == len(odd)
    text = {(r["doc_id"], r["n_lines"]): r for r in got}
    assert text[1, 0]["text"] is None and text[2, 1]["text"] == "" and text[9, 5]["text"] == "line\nline"[:4]
    assert text[9, 5]["n_removed"] == 4 and text[9, 1]["n_removed"] == 0
    assert line_dedup.dedup_lines(docs([])).collect() == []
    # Rows that agree in id and text are one document; another id is a later one.
    twice = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc"), (None, "d\ne\nf"), (3, "d\ne\nf")]
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in line_dedup.dedup_lines(docs(twice)).collect()) == [("1", 0), ("1", 0), ("2", 3), ("3", 3), ("None", 0)]


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_near(rows):
    sets = defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[i].append(shingles(t))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def check_near(rows, got):
    want = brute_near([(r[0], r[1]) for r in rows])
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"])
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert sorted(r["n_shingles"] for r in got) == sorted(len(shingles(r[1])) for r in rows)


@pytest.mark.parametrize(("short", "block"), [(64, 768), (4, 16)])
def test_near(docs, prose, monkeypatch, short, block):
    """With short lists and small blocks, the way for long lists does the work."""
    monkeypatch.setattr(near_dedup, "SHORT", short)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    check_near(prose, near_dedup.near_duplicates(docs(prose)).collect())


def test_near_by_stars_and_shuffles(docs, prose, monkeypatch):
    """Nothing is small enough for one task or a broadcast."""
    monkeypatch.setattr(_shared, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(near_dedup, "SHORT", 8)
    check_near(prose[:200], near_dedup.near_duplicates(docs(prose[:200])).collect())


@pytest.mark.parametrize("most", [1, 1000])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(_shared, "BROADCAST_ROWS", most)
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, 7), (7, 3), (3, 100), (5, 5), (60, 50), (50, 61), (61, 62)]
    got = {r["id"]: r["label"] for r in _shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, **{i: 3 for i in (3, 7, 100)}, **{i: 50 for i in (50, 60, 61, 62)}}


def test_near_with_a_common_passage(docs):
    """A passage in 1,200 documents: some with much text of their own, near copies among them, some with little."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows = [passage + [word() for _ in range(rng.choice((90, 60, 40)))] for _ in range(1000)]
    for i in range(0, 400, 8):
        rows.append([w if rng.random() > 0.015 else word() for w in rows[i]])
    rows += [[word() for _ in range(3)] + passage[rng.randint(0, 8) :] + [word() for _ in range(rng.randint(0, 30))] for _ in range(150)]
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    sets = [shingles(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x] if j < i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs(rows)).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


def test_near_common_values_are_not_listed(docs, monkeypatch):
    """What long lists show to be common is counted, not listed by single values; links are the same with and without."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows = [passage + [word() for _ in range(rng.randint(5, 45))] for _ in range(150)]
    rows += [[w if rng.random() > 0.01 else word() for w in rows[i]] for i in range(0, 60, 3)]
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    listed, plain = [], near_dedup._lists
    monkeypatch.setattr(near_dedup, "_lists", lambda keys: listed.append(keys) or plain(keys))
    check_near(rows, near_dedup.near_duplicates(docs(rows)).collect())
    asked = {r["rep"] for r in listed[1].select("rep").distinct().collect()}
    kept = sum(min(near_dedup.K, len(shingles(dict(rows)[i]))) for i in asked)
    assert len(asked) > near_dedup.SHORT and listed[1].count() < 0.8 * kept
    monkeypatch.setattr(near_dedup, "KNOWN", 1)
    check_near(rows, near_dedup.near_duplicates(docs(rows)).collect())


def test_near_small_sets(docs):
    rows = [(i, " ".join(f"w{j}" for j in range(a, a + n))) for i, (a, n) in enumerate([(0, 7), (0, 8), (1, 8), (0, 5), (0, 4), (0, 4), (0, 9), (3, 40), (4, 40), (3, 60)])]
    check_near(rows, near_dedup.near_duplicates(docs(rows)).collect())


def test_near_odd(docs, odd):
    rows = odd + [(11, "OTHER  text\tFOR the same id"), (12, "line line line line line line"), (13, "ünï ☃ 😀 naïve x\x1cy z")]
    check_near(rows, near_dedup.near_duplicates(docs(rows)).collect())
    assert near_dedup.near_duplicates(docs([])).collect() == []
