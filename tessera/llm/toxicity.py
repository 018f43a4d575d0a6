"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the mean of the hashed embeddings of the word and of its first 3, 4,
5 and 6 letters. Filters of several widths run over the whole text; each keeps its
maximum, and a logistic layer weighs the maxima. As filters are linear, each distinct word
meets them once, and a window is the sum of its words' parts.

Training sees every labelled document. They are dealt over parts of bounded size by a hash of
their ids; in each round every part trains on its documents, in a task of its own, and the
parameters are averaged. The embeddings start from the smoothed log odds of each bucket in all
labelled documents, so that the maxima point at telling words from the first step. On a fifth
of them, held out of the rounds' training, a threshold is calibrated for each language; the language decides
which threshold applies and never enters a score.

Memory: texts are scored some 100,000 words at a time, also within a text.

Defined results: a null text is an empty one; an empty text gets the score of no evidence;
of several labels of one id the greatest counts, and of its texts the one with the smallest
hash; a language without calibration gets the given threshold; without labels of both kinds all
scores are the smoothed base rate; rows with equal ids are scored one by one; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

import copy
import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, lean, small_batches, stored

_words = re.compile(r"\w+").findall
PREFIXES = (3, 4, 5, 6)
WIDTHS = (1, 2, 3)
CHUNK, CACHE = 100_000, 200_000
#: Characters of a part of the labelled documents, on average at most.
MOST_CHARS = 64 << 20
#: Rounds of training, epochs of each part in a round; pieces of the parameters when they are averaged.
ROUNDS, EPOCHS, PIECES = 3, 2, 16


def _found(text: str):
    """The words of a text; of a long one, one after the other."""
    text = text.lower()
    return _words(text) if len(text) < 1 << 20 else (m.group() for m in re.finditer(r"\w+", text))


class Vocabulary:
    """Numbers for words, with the buckets of each word's parts; row 0 stands between documents."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self):
        self.known: dict[str, int] = {}
        self.table, self.done = np.zeros((1024, 1 + len(PREFIXES)), np.int32), 0
        self.fresh = [(self.buckets,) * (1 + len(PREFIXES))]

    @property
    def parts(self) -> np.ndarray:
        """Buckets of all words so far, one row a word; only new words are converted."""
        n = self.done + len(self.fresh)
        if n > len(self.table):
            self.table = np.concatenate([self.table[: self.done], np.zeros((2 * n - self.done, self.table.shape[1]), np.int32)])
        if self.fresh:
            self.table[self.done : n] = self.fresh
            self.done, self.fresh = n, []
        return self.table[:n]

    def __call__(self, text: str) -> list[int]:
        known, out = self.known, []
        for w in _found(text):
            at = known.get(w)
            if at is None:
                at = known[w] = self.done + len(self.fresh)
                whole = zlib.crc32(w.encode()) % self.buckets
                self.fresh.append((whole, *(zlib.crc32(w[:k].encode(), k) % self.buckets if len(w) >= k else whole for k in PREFIXES)))
            out.append(at)
        return out


class Network:
    def __init__(self, buckets: int = 1 << 16, size: int = 12, filters: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.buckets = buckets
        self.embed = np.concatenate([rng.normal(0, 0.05, (buckets, size)), np.zeros((1, size))]).astype(np.float32)
        self.conv = [rng.normal(0, 0.3, (w, size, filters)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), filters), np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS), filters)).astype(np.float32)
        self.base = 0.0
        #: Sums of squared gradients, which the steps of training shrink with.
        self.steps = {"embed": np.full(buckets + 1, 1e-4, np.float32), "out": np.full(self.out.shape, 1e-6), "bias": np.full(self.bias.shape, 1e-6), "base": np.full(1, 1e-6)}
        self.steps |= {f"conv{k}.{j}": np.full(c[j].shape, 1e-6) for k, c in enumerate(self.conv) for j in range(len(c))}

    def warm(self, seen: np.ndarray, n: np.ndarray) -> None:
        """The first size of every embedding: log odds of its bucket; one filter of width 1 reads it.

        seen: documents of each class with each bucket; n: documents of each class."""
        n = np.maximum(1, n)
        odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
        odds *= np.minimum(1, seen.sum(0) / 3)  # a few sightings are little evidence
        self.embed[:, 0] = np.clip(odds, -3, 3)
        self.embed[-1] = 0
        for c in self.conv:
            c[:, 0, 0] = 1.0 / len(c)
        self.out[:, 0] = 0.5
        self.base = float(np.log((n[1] + 1) / (n[0] + 1))) - 1

    def parameters(self) -> np.ndarray:
        return np.concatenate([np.ravel(x) for x in (self.embed, *self.conv, self.bias, self.out, *self.steps.values(), self.base)]).astype(np.float64)

    def take(self, values: np.ndarray) -> None:
        """The inverse of `parameters`."""
        at = 0
        for x in (self.embed, *self.conv, self.bias, self.out, *self.steps.values()):
            x[...] = values[at : at + x.size].reshape(x.shape)
            at += x.size
        self.base = float(values[at])

    def windows(self, tokens: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
        """Values of the filters of a width at each place; the text is followed by enough separators."""
        c, n = self.conv[k], len(tokens) - len(self.conv[k]) + 1
        return sum((vectors @ c[j])[tokens[j : j + n]] for j in range(len(c)))

    @staticmethod
    def lay(docs: list) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all documents, each followed by separators, and where each starts."""
        gap = max(WIDTHS)
        sizes = np.array([len(d) + gap for d in docs])
        flat = np.zeros(sizes.sum() + gap, np.int64)
        starts = np.cumsum(sizes) - sizes
        for s, d in zip(starts, docs, strict=True):
            flat[s : s + len(d)] = d
        return flat, starts

    def forward(self, docs: list, parts: np.ndarray, places: bool = False):
        tokens, starts = self.lay(docs)
        used, tokens = np.unique(tokens, return_inverse=True)
        vectors = self.embed[parts[used]].mean(1)
        end = len(tokens) - max(WIDTHS)
        best, at = [], []
        ends = np.append(starts[1:], end)
        for k, width in enumerate(WIDTHS):
            v = self.windows(tokens, vectors, k)[:end]
            for j in range(1, width):  # these would reach into the next document
                v[ends - j] = -np.inf
            top = np.maximum.reduceat(v, starts, axis=0)
            best.append(top)
            if places:
                doc = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, end)))
                i, f = np.nonzero(v == top[doc])
                where = np.zeros(top.shape, np.int64)
                where[doc[i][::-1], f[::-1]] = i[::-1]
                at.append(where)
        best = np.stack(best, 1)  # documents x widths x filters
        if not places:
            return self.head(best)
        hidden = np.maximum(best + self.bias, 0)
        z = np.tensordot(hidden, self.out, 2) + self.base
        return z, hidden, tokens, used, vectors, at

    def head(self, best: np.ndarray) -> np.ndarray:
        return np.tensordot(np.maximum(best + self.bias, 0), self.out, 2) + self.base

    def long(self, doc: list, parts: np.ndarray, chunk: int) -> np.ndarray:
        """forward of one document, `chunk` places at a time."""
        gap = max(WIDTHS)
        tokens = np.append(np.asarray(doc, np.int64), np.zeros(gap, np.int64))
        best = np.full((1, len(WIDTHS), self.bias.shape[1]), -np.inf, np.float32)
        for a in range(0, len(tokens), chunk):
            used, piece = np.unique(tokens[a : a + chunk + gap - 1], return_inverse=True)
            vectors = self.embed[parts[used]].mean(1)
            for k, width in enumerate(WIDTHS):
                if len(piece) >= width:
                    v = self.windows(piece, vectors, k)[:chunk]
                    best[0, k] = np.maximum(best[0, k], v.max(0))
        return self.head(best)

    def fit(self, docs: list[np.ndarray], parts: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 7) -> None:
        """Epochs over the documents, from the parameters as they are."""
        rng = np.random.default_rng(seed)
        seen = self.steps

        def adapt(name, value, grad):
            old = seen[name]
            old += grad * grad
            return value - rate * grad / np.sqrt(old)

        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for b in range(0, len(order), batch):
                pick = order[b : b + batch]
                z, hidden, tokens, used, vectors, at = self.forward([docs[i] for i in pick], parts, True)
                slope = ((1 / (1 + np.exp(-z)) - labels[pick]) / len(pick)).astype(np.float32)
                g_out = np.tensordot(slope, hidden, 1)
                g_hidden = slope[:, None, None] * self.out * (hidden > 0)
                rows, grads = [], []
                for k in range(len(WIDTHS)):
                    g = g_hidden[:, k]
                    for j in range(len(self.conv[k])):
                        t = tokens[at[k] + j]
                        g_conv = np.einsum("nfd,nf->df", vectors[t], g)
                        rows.append(used[t].ravel())
                        grads.append((g[:, :, None] * self.conv[k][j].T[None]).reshape(-1, vectors.shape[1]))
                        self.conv[k][j] = adapt(f"conv{k}.{j}", self.conv[k][j], g_conv)
                self.out = adapt("out", self.out, g_out).astype(np.float32)
                self.bias = adapt("bias", self.bias, g_hidden.sum(0)).astype(np.float32)
                self.base = float(adapt("base", np.array([self.base]), np.array([slope.sum()]))[0])
                cells = parts[np.concatenate(rows)]
                share = np.repeat(np.concatenate(grads) / cells.shape[1], cells.shape[1], axis=0)
                cell, back = np.unique(cells.ravel(), return_inverse=True)
                sums = np.zeros((len(cell), share.shape[1]), np.float32)
                np.add.at(sums, back, share)
                seen["embed"][cell] += (sums * sums).mean(1)
                self.embed[cell] -= rate * sums / np.sqrt(seen["embed"][cell])[:, None]
                self.embed[-1] = 0


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


PACKED = ("parts", "tokens", "sizes", "labels", "held")


def _pack(buckets: int):
    """The rows of a part as one row: buckets of its words, words of its documents, labels."""

    def run(table: pa.Table) -> pa.Table:
        known = Vocabulary(buckets)
        rows = sorted(zip(*[table.column(c).to_pylist() for c in ("place", "doc_id", "toxic", "held", "lang")], range(len(table)), strict=True), key=lambda r: (r[0], str(r[1])))
        docs = [np.array(known(table.column("text")[r[-1]].as_py() or ""), np.int32) for r in rows]
        arrays = (known.parts, np.concatenate(docs), np.array([len(d) for d in docs]), np.array([int(r[2]) for r in rows]), np.array([r[3] for r in rows], bool))
        pack = zstandard.ZstdCompressor(level=1).compress
        cells = {n: [pack(np.ascontiguousarray(x).tobytes())] for n, x in zip(PACKED, arrays, strict=True)}
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int64()), **{n: pa.array(v, pa.binary()) for n, v in cells.items()}, "langs": pa.array([[r[4] for r in rows]], pa.list_(pa.string()))})

    return run


def _unpacked(batches):
    """(part, documents, buckets of their words, labels, held, langs) of each packed part."""
    for b in batches:
        for i in range(b.num_rows):
            parts, tokens, sizes, labels, held = (np.frombuffer(zstandard.ZstdDecompressor().decompress(b.column(n)[i].as_py()), t) for n, t in zip(PACKED, (np.int32, np.int32, np.int64, np.int64, bool), strict=True))
            docs = np.split(tokens, np.cumsum(sizes)[:-1])
            yield b.column("part")[i].as_py(), docs, parts.reshape(-1, 1 + len(PREFIXES)), labels, held, b.column("langs")[i].as_py()


def _seen(buckets: int):
    def run(batches):
        seen, n = np.zeros((2, buckets + 1), np.int64), np.zeros(2, np.int64)
        for _, docs, parts, labels, held, _ in _unpacked(batches):
            for i in np.flatnonzero(~held):
                seen[labels[i], np.unique(parts[docs[i]])] += 1
            n += np.bincount(labels[~held], minlength=2)
        y, bucket = np.nonzero(seen)
        cells = [np.append(y, [0, 1]), np.append(bucket, [-1, -1]), np.append(seen[y, bucket], n)]  # bucket -1: documents
        for a in range(0, len(cells[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000], pa.int64()) for c in cells], ["y", "bucket", "n"])

    return run


def _epochs(shared, epochs: int):
    """Each part's parameters after its epochs, in pieces, times its documents."""

    def run(batches):
        for part, docs, parts, labels, held, _ in _unpacked(batches):
            own = np.flatnonzero(~held)
            if not len(own):
                continue
            net = copy.deepcopy(shared.value)
            net.fit([docs[i] for i in own], parts, labels[own], epochs=epochs, seed=part)
            pieces = np.array_split(net.parameters() * len(own), PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int64()), pa.array([part] * PIECES, pa.int64()), pa.array([len(own)] * PIECES, pa.int64()), pa.array([x.tobytes() for x in pieces], pa.binary())], ["piece", "part", "n", "sums"])

    return run


def _mean(table: pa.Table) -> pa.Table:
    order = np.argsort(table.column("part").to_numpy())
    total = sum(np.frombuffer(table.column("sums")[int(i)].as_py()) for i in order) / table.column("n").to_numpy().sum()
    return pa.table({"piece": table.column("piece")[:1].cast(pa.int64()), "mean": pa.array([total.tobytes()], pa.binary())})


def _held_scores(shared, grid: np.ndarray):
    """Held documents: language, label, and how many thresholds of the grid the score reaches."""

    def run(batches):
        net = shared.value
        for _, docs, parts, labels, held, langs in _unpacked(batches):
            at = np.flatnonzero(held)
            scores = [_sigmoid(net.forward([docs[i]], parts) if len(docs[i]) <= CHUNK else net.long(docs[i], parts, CHUNK))[0] for i in at]
            yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in at], pa.string()), pa.array(labels[at], pa.int64()), pa.array(np.searchsorted(grid, np.array(scores, float), "right"), pa.int64())], ["lang", "y", "bin"])

    return run


def train(docs: DataFrame, labels: DataFrame, most: int = 3000, threshold: float = 0.3, most_chars: int = MOST_CHARS) -> tuple[Network, dict[str, float]]:
    """The network and the thresholds by language, from all labelled documents.

    docs: doc_id, text, lang; labels: doc_id, toxic (rows that may be learned from). An id
    with several labels has the greatest one. A part has some 2 * `most` documents and
    `most_chars` characters, and is trained on in one task; more documents give more parts.
    """
    spark = docs.sparkSession
    labels = stored(labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(labels) if labels.count() <= BROADCAST_ROWS else labels, "doc_id")
    place = F.xxhash64(F.col("doc_id"), F.lit("place"))
    held = F.pmod(place, F.lit(5)) == 4
    n, chars, least, greatest, kinds = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0)), F.min("toxic"), F.max("toxic"), F.count_distinct(F.when(~held, F.col("toxic")))).first()
    net = Network()
    if not n or least == greatest:
        sizes = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
        net.out[:], net.base = 0, float(np.log((sizes.get(1, 0) + 1) / (sizes.get(0, 0) + 1)))
        return net, {}
    n_parts = max(1, -(-n // (2 * most)), -(-chars // most_chars))
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by(F.struct("text", "lang"), F.struct(F.coalesce(F.xxhash64("text"), F.lit(0)), "lang")).alias("r"))
    rows = rows.select("doc_id", "toxic", "r.*", place.alias("place"), F.pmod(F.xxhash64("doc_id"), F.lit(n_parts)).cast("long").alias("part"), (held if kinds == 2 else F.lit(False)).alias("held"))
    packed = stored(rows.groupBy("part").applyInArrow(_pack(net.buckets), "part long, " + ", ".join(f"{c} binary" for c in PACKED) + ", langs array<string>"))

    counts = packed.mapInArrow(lean(_seen(net.buckets)), "y long, bucket long, n long").groupBy("y", "bucket").agg(F.sum("n").alias("n")).toArrow()
    y, bucket, found = (counts.column(c).to_numpy() for c in ("y", "bucket", "n"))
    seen, sizes = np.zeros((2, net.buckets + 1)), np.zeros(2)
    seen[y[bucket >= 0], bucket[bucket >= 0]] = found[bucket >= 0]
    sizes[y[bucket < 0]] = found[bucket < 0]
    net.warm(seen, sizes)
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(net)
        means = packed.mapInArrow(lean(_epochs(shared, EPOCHS)), "piece long, part long, n long, sums binary").groupBy("piece").applyInArrow(_mean, "piece long, mean binary").toArrow().sort_by("piece")
        if len(means):
            net.take(np.concatenate([np.frombuffer(x.as_py()) for x in means.column("mean")]))
        shared.destroy()
    shared = spark.sparkContext.broadcast(net)
    grid = np.unique([threshold, *np.round(np.linspace(0.05, 0.95, 19), 2)])
    bins = packed.mapInArrow(lean(_held_scores(shared, grid)), "lang string, y long, bin long").where("lang is not null").groupBy("lang", "y", "bin").count().collect()
    shared.destroy()
    limits = {}
    for lang in {r["lang"] for r in bins}:
        own = [r for r in bins if r["lang"] == lang]
        times = [r["count"] for r in own]
        limits[lang] = calibrated(np.repeat([np.append(-1.0, grid)[r["bin"]] for r in own], times), np.repeat([r["y"] for r in own], times), threshold)
    return net, limits


def calibrated(score: np.ndarray, y: np.ndarray, threshold: float) -> float:
    """The threshold with the best F1, the given one on a tie or with few cases."""
    if y.sum() < 5 or len(y) - y.sum() < 5:
        return threshold
    f1 = lambda t: 2 * (y[score >= t].sum()) / max(1, (score >= t).sum() + y.sum())
    return max([threshold, *np.round(np.linspace(0.05, 0.95, 19), 2)], key=lambda t: (f1(t), t == threshold))


def score(docs: DataFrame, net: Network, limits: dict[str, float], threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, score, lang_threshold, flagged (by that threshold). docs: doc_id, text, lang."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = shared.value
        known = Vocabulary(net.buckets)
        for b in batches:
            out, docs, held = [], [], 0

            def flush():
                if docs:
                    out.append(_sigmoid(net.forward(docs, known.parts)))
                docs.clear()

            for t in b.column("text"):
                if not docs and known.done > CACHE:
                    known.clear()
                doc = known(t.as_py() or "")
                if len(doc) > CHUNK:
                    flush()
                    out.append(_sigmoid(net.long(doc, known.parts, CHUNK)))
                    held = 0
                    continue
                docs.append(doc)
                held += len(doc)
                if held >= CHUNK:
                    flush()
                    held = 0
            flush()
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(scores.astype(float))], ["doc_id", "lang", "score"])

    schema = docs.limit(0).select("doc_id", "lang", F.lit(0.0).alias("score")).schema
    scored = docs.select("doc_id", "lang", "text").mapInArrow(lean(run), schema)
    limit: Column = F.lit(float(threshold))
    for lang, t in sorted(limits.items()):
        limit = F.when(F.col("lang") == lang, F.lit(float(t))).otherwise(limit)
    return scored.select("doc_id", "score", limit.alias("lang_threshold"), (F.col("score") >= limit).alias("flagged"))


def toxicity(docs: DataFrame, labels: DataFrame, most: int = 3000, threshold: float = 0.3, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """Train on the labels given and score every document."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    small_batches(docs.sparkSession)
    net, limits = train(docs, labels, most, threshold)
    return score(docs, net, limits, threshold)
