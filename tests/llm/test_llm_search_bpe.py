import base64
import math
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from tessera.llm import bpe, search

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def brute_search(rows, asked, k):
    """Scores of all documents in millionths, term by term."""
    docs = [(i, Counter((t or "").encode().lower().split())) for i, t in rows if i is not None]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    out = []
    for q, text in asked:
        scores = []
        for i, c in docs:
            length = sum(c.values())
            score = 0
            for w, qtf in Counter((text or "").encode().lower().split()).items():
                if w in c:
                    value = c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length / (total / n)))
                    score += round(qtf * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * value * 1e6)
            if score > 0:
                scores.append((-score, i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def check_search(got, want):
    key = lambda r: (r[0], r[1])
    got = sorted([(r["query_id"], r["rank"], r["doc_id"], round(r["score"] * 1e6)) for r in got], key=key)
    want = sorted(want, key=key)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) <= 3 for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize(("shard", "terms", "k"), [(8192, 2_000_000, 5), (37, 400, 10), (16, 100, 1)])
def test_search(docs, prose, shard, terms, k):
    """Several shards in one task, and several blocks of queries."""
    df = docs(prose)
    asked = [r for r in prose if r[0] % 20 == 0] + [(999, "unknown words only"), (998, None)]
    check_search(search.top_k(df, docs(asked), k=k, shard_docs=shard, query_terms=terms).collect(), brute_search(prose, asked, k))
    index = search.build_index(df.select("doc_id", "text"), shard)
    assert index.count() >= len(prose) // shard and index.select("shard").distinct().count() == index.count()


@pytest.mark.parametrize(("block", "share", "cells"), [(1, 1 / 16, 8 << 20), (4, 0, 8 << 20), (64, 0.01, 2000), (4, 1, 8 << 20)])
def test_shard_is_exact(prose, monkeypatch, block, share, cells):
    """The pruned way against all scores, within one shard: with all terms frequent or rare, and with thresholds from elsewhere."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(search, "CELLS", cells)
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in prose], "text": [t for _, t in prose]})
    (row,) = search._shard_rows([batch], 8192, 1 << 30)
    shard = search.Shard([row.column(p)[0].as_py() for p in search.PARTS], float(row.column("words")[0].as_py()) / len(prose), block, share)
    lengths = search._unpack(row.column("lengths")[0].as_py(), np.int32)
    tfs = search._unpack(row.column("tfs")[0].as_py(), np.uint32).astype(float)
    norm = 1.2 * (0.25 + 0.75 * lengths / (lengths.sum() / len(lengths)))
    rng = np.random.default_rng(block)
    for i in range(60):
        numbers = np.sort(rng.choice(len(shard.terms), rng.integers(1, 40), replace=False))
        weights = rng.random(len(numbers)) * 5
        full = np.zeros(shard.n)
        for t, w in zip(numbers, weights, strict=True):
            at = slice(shard.starts[t], shard.starts[t] + shard.counts[t])
            full[shard.docs[at]] += np.rint(w * (tfs[at] * 2.2 / (tfs[at] + norm[shard.docs[at]])) * search.SCALE)
        least = 0.0 if i % 3 else float(np.quantile(full, 0.9))
        order = np.lexsort((shard.ids, -full))[:7]
        order = order[(full[order] > 0) & (full[order] >= least)]
        ids, scores = shard.best(numbers, weights, 7, least)
        assert ids.tolist() == shard.ids[order].tolist() and scores.tolist() == full[order].tolist()
    assert len(shard.row[shard.row >= 0]) <= cells / shard.n


@pytest.mark.parametrize("held", [2, 1_000_000])
def test_frequencies_are_summed(prose, monkeypatch, held):
    """A task sends one row for each term, not one for each term and shard, unless it holds too many."""
    import pyarrow as pa

    monkeypatch.setattr(search, "HELD_TERMS", held)
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in prose], "text": [t for _, t in prose]})
    shards = list(search._shard_rows([batch], 20, 1 << 30))
    got = [(t, n) for b in search._frequencies(shards) for t, n in zip(b.column("term").to_pylist(), b.column("df").to_pylist(), strict=True)]
    of, want, sums = search.Terms(), Counter(), Counter()
    for _, t in prose:
        want.update(of(t)[0].tolist())
    for t, n in got:
        sums[t] += n
    assert sums == want and len(shards) > 5
    assert held == 2 or len(got) == len(want)


def test_every_row_is_asked(docs):
    """Rows with one id are separate queries, whatever their order."""
    rows, asked = [(1, "a b"), (2, "c d"), (3, "a d")], [(50, "a b"), (50, "c"), (50, "a b")]
    for some in (asked, asked[::-1]):
        got = search.top_k(docs(rows), docs(some, 1), k=2).collect()
        assert sorted((r["query_id"], r["rank"], r["doc_id"]) for r in got) == [(50, 1, 1), (50, 1, 1), (50, 1, 2), (50, 2, 3), (50, 2, 3)]


def test_search_odd(docs, odd):
    rows = [(r[0], r[1]) for r in odd]
    got = search.top_k(docs(odd), docs([(4, "ONE two three"), (7, "a"), (None, "a"), (8, "")]), k=3).collect()
    check_search(got, brute_search(rows, [(4, "ONE two three"), (7, "a")], 3))
    assert search.top_k(docs([]), docs([]), k=3).collect() == []
    assert search.top_k(docs(odd), docs([]), k=3).collect() == []


@pytest.fixture(scope="module")
def exact():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("block_bytes", [1, 500, 32 << 20])
def test_bpe(docs, prose, odd, exact, block_bytes):
    rows = [(r[0], r[1]) for r in odd] + prose[:40] + [(700, "<|endoftext|> it's  we'll x y 12,345\r\n\t z "), (701, "日本語テキスト🙂🙂"), (702, "\x00\x1c\x85 a"), (703, "'S 'LL")]
    out = bpe.decode(bpe.encode(docs(rows), PATH, PATTERN, block_bytes), PATH).collect()
    both = bpe.encode(docs(rows), PATH, PATTERN, block_bytes, decoded=True)
    assert sorted(map(str, both.collect())) == sorted(map(str, out)) and both.columns == ["doc_id", "ids", "decoded"]
    want = sorted((str(i), exact.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert sorted((str(r["doc_id"]), list(r["ids"]), bytes(r["decoded"])) for r in out) == want


def test_bpe_empty(docs):
    assert bpe.decode(bpe.encode(docs([]), PATH, PATTERN), PATH).collect() == bpe.encode(docs([]), PATH, PATTERN, decoded=True).collect() == []
