import zlib
from collections import Counter, defaultdict

import pytest

from tessera.llm import mixing, sharding


def check_shards(rows, got, shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert set(by) <= set(range(shards))
    return by


def test_shards_balance(docs, prose):
    got = sharding.shard_documents(docs(prose), shards=4, group_slack=0.0).collect()
    by = check_shards(prose, got, 4)
    sizes = [sum(r["size"] for r in by[s]) for s in range(4)]
    assert max(sizes) - min(sizes) <= 2 * max(len(t.encode()) for _, t in prose)
    again = sharding.shard_documents(docs(prose, 5), shards=4, group_slack=0.0).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_copies_stay_together_or_are_split(docs, prose):
    rows = prose + [(1000 + i, "the same text") for i in range(9)]
    got = sharding.shard_documents(docs(rows), shards=4, group_slack=0.05).collect()
    assert len({r["shard"] for r in got if r["doc_id"] >= 1000}) == 1
    heavy = [(i, "copy " * 50) for i in range(300)]
    by = check_shards(heavy, sharding.shard_documents(docs(heavy), shards=4).collect(), 4)
    assert [len(by[s]) for s in range(4)] == [75] * 4


def test_shards_odd(docs, odd):
    check_shards(odd, sharding.shard_documents(docs(odd), shards=3).collect(), 3)
    assert sharding.shard_documents(docs([]), shards=3).collect() == []
    check_shards(odd[:1], sharding.shard_documents(docs(odd[:1]), shards=16).collect(), 16)


def test_shards_carry_columns(docs, prose):
    got = sharding.shard_documents(docs(prose), shards=3, columns=["text", "n"]).select("doc_id", "row.text", "shard", "slot").collect()
    assert {r["doc_id"]: r["text"] for r in got} == dict(prose)
    plain = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_documents(docs(prose), shards=3).collect()}
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == plain


def wanted(rows, weights=(5, 2, 1), most=3):
    from conftest import words

    size = defaultdict(int)
    for _, t, *s in rows:
        size[s[0] if s else "s"] += len(words(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free = dict.fromkeys(names, 0.0), set(names)
    excess = float(sum(size.values()))
    while excess > 1e-9 and free:  # reshare until no source is above
        share = {s: excess * weight[s] / sum(weight[x] for x in free) for s in free}
        excess = 0.0
        for s in share:
            target[s] += share[s]
            if target[s] > most * size[s]:
                excess += target[s] - most * size[s]
                target[s] = float(most * size[s])
                free.discard(s)
    return size, target


def test_mix_targets(docs, prose):
    from conftest import words

    rows = [(i, t, f"s{min(i % 11, 5)}" if i % 13 else None) for i, t in prose] + [(900, "lone word", "zz"), (901, "", "empty")]
    size, target = wanted(rows)
    got = mixing.mix(docs(rows)).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    largest = defaultdict(int)
    for _, t, s in rows:
        largest[s] = max(largest[s], len(words(t)))
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s]
    again = mixing.mix(docs(rows, 7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_emit(docs, prose, odd):
    rows = [(i, t, f"s{i % 3}") for i, t in prose] + [(*r, "s")[:3] for r in odd]
    df = docs(rows)
    plan = Counter()
    for r in mixing.mix(df).collect():
        plan[r["doc_id"], r["text_hash"]] += r["copies"]
    out = mixing.emit(df)
    assert out.columns == df.columns
    seen = Counter((r["doc_id"], r["h"]) for r in out.selectExpr("doc_id", "xxhash64(text) AS h").collect())
    assert seen == Counter({k: v for k, v in plan.items() if v})


def test_mix_odd(docs, odd):
    assert len(mixing.mix(docs(odd)).collect()) == len(odd)
    assert mixing.mix(docs([])).collect() == []
    blank = mixing.mix(docs([(1, None), (2, "")])).collect()
    assert [r["taken"] for r in blank] == [0, 0]
