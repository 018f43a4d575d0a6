"""Byte-level BPE encoding and decoding over the distinct words of the corpus.

Encoding: texts are split into pre-tokens once. A block of documents (up to `block_bytes`
of text) keeps the positions as sequences of numbers of its own distinct words, and lists
these words by bucket, a hash of the word. The lists are shuffled by bucket: whatever
equals a word is in the same bucket, so each distinct word of the corpus meets the merges
once. The ids go back to the blocks, and a block's documents are put together by position,
some hundred kilobytes of text at a time. A word, however frequent, is one entry for each
block, so no key is hot; there are eight times as many buckets as the shuffle has
partitions, and only one is held in memory.

A block's key holds a hash of its texts, and its sequences know how many words it has: if a
lost task is run again and its input comes in another order, the result is an error, not a gap.

Decoding: the ids are joined to the token-byte table, whose size is the vocabulary's: a
hash join of each batch of documents with the broadcast table.

Defined results: a null text encodes as the empty one, to no ids; rows with equal ids or
texts are encoded one by one; empty tables give empty results; other columns are ignored.
Decoding null ids gives null, and ids that the table doesn't have are an error.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import lean, shuffle_partitions, small_batches

#: Pre-tokens that are in memory as text at once; text of the documents that are packed together.
AT_ONCE, CELL_BYTES = 200_000, 128 << 10
WORDS, SEQUENCE = 0, 1  # kinds of rows, in the order in which a block needs them


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, compressed; numbers by planes of bytes, as most of them are small."""
    head = np.array([[len(a), a.dtype.itemsize] for a in arrays], "<u4").tobytes()
    planes = [a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"" for a in arrays]
    return len(arrays).to_bytes(1, "little") + head + zstandard.ZstdCompressor(level=6).compress(b"".join(planes))


def _unpack(data: bytes) -> list[np.ndarray]:
    """The arrays, as unsigned numbers of the sizes they had."""
    n = data[0]
    head = np.frombuffer(data, "<u4", 2 * n, 1).reshape(n, 2).tolist()
    flat, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1 + 8 * n :]), np.uint8), 0, []
    for size, wide in head:
        part = flat[at : at + size * wide]
        out.append(np.ascontiguousarray(part.reshape(wide, size).T).view(f"<u{wide}").ravel() if size else np.zeros(0, f"<u{wide}"))
        at += size * wide
    return out


def _pack_numbers(seq: np.ndarray) -> bytes:
    """Numbers below 255 as one byte; of the others a 255 there, and what is beyond by itself."""
    return _pack(np.minimum(seq, 255).astype(np.uint8), (seq[seq >= 255] - 255).astype("<u4"))


def _unpack_numbers(data: bytes) -> np.ndarray:
    low, large = _unpack(data)
    seq = low.astype(np.uint32)
    seq[low == 255] += large
    return seq


class Block:
    """Documents as sequences of numbers, and their distinct words in the order of the numbers."""

    def __init__(self):
        self.number: dict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids: list = []
        self.seqs: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.digest = xxhash.xxh3_64()

    def add(self, doc_id, text: str, split) -> None:
        self.digest.update(text.encode())
        parts, found = [], (m.group() for m in split.finditer(text)) if len(text) > AT_ONCE else iter(split.findall(text))
        while True:
            parts.append(np.fromiter(map(self.number.__getitem__, islice(found, AT_ONCE)), np.uint32))
            if len(parts[-1]) < AT_ONCE:
                break
        self.seqs.append(np.concatenate(parts) if len(parts) > 1 else parts[0])
        self.ids.append(doc_id)
        self.sizes.append(len(text))

    def rows(self, place: str, buckets: int):
        """(dest, block, kind, doc_ids, data) of the sequences and of the words of each bucket. Frequent words get small numbers."""
        key = xxhash.xxh3_64_intdigest(f"{place}:{self.digest.hexdigest()}") - 2**63
        counts = np.zeros(len(self.number), np.int64)
        for s in self.seqs:
            counts += np.bincount(s, minlength=len(counts))
        order = np.argsort(-counts, kind="stable")
        new = np.empty(len(order), np.uint32)
        new[order] = np.arange(len(order))
        start, held = 0, 0
        for i, size in enumerate(self.sizes):
            held += size
            if held >= CELL_BYTES or i == len(self.sizes) - 1:
                part = self.seqs[start : i + 1]
                sizes = np.array([len(s) for s in part], "<u8")
                data = _box(_pack(sizes), _pack_numbers(new[np.concatenate(part)]), len(order).to_bytes(8, "little"))
                yield buckets + (key + i) % (1 << 40), key, SEQUENCE, self.ids[start : i + 1], data
                start, held = i + 1, 0
        self.seqs.clear()
        words = [w.encode() for w in self.number]
        self.number.clear()
        bucket = np.array([xxhash.xxh3_64_intdigest(w) % buckets for w in words], np.int64)
        place = np.lexsort((new, bucket))
        ends = np.flatnonzero(np.diff(bucket[place], append=-1)) + 1
        for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            at = place[s:e]
            own = [words[i] for i in at.tolist()]
            steps = np.diff(new[at].astype(np.int64), prepend=0).astype("<u4")
            yield int(bucket[at[0]]), key, WORDS, None, _pack(steps, np.array([len(w) for w in own], "<u4"), np.frombuffer(b"".join(own), np.uint8))


NAMES = ["block", "kind", "doc_ids", "data"]


def _box(*cells: bytes) -> bytes:
    return b"".join(len(c).to_bytes(4, "little") + c for c in cells)


def _unbox(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _split(pattern: str, block_bytes: int, buckets: int, kind: pa.DataType):
    types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(kind), pa.binary()]

    def run(batches):
        split, part, nth = regex.compile(pattern), TaskContext.get().partitionId(), 0
        block, held = Block(), 0

        def out():
            rows = block.rows(f"{part}:{nth}", buckets)
            while some := list(islice(rows, 100)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], ["dest", *NAMES])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                t = text.as_py() or ""
                block.add(doc_id, t, split)
                held += len(t)
                if held >= block_bytes:
                    yield from out()
                    block, held, nth = Block(), 0, nth + 1
        if block.ids:
            yield from out()

    return run


def _merge(ranks, pattern: str, dtype: str):
    """Ids of the words of each list; lists of a bucket stand together, and the merges see each of its words once."""

    def run(batches):
        import tiktoken  # here only: the tasks that split texts need the memory

        one = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})._encode_single_piece
        last, known = None, {}
        for b in batches:
            kinds, cells = b.column("kind").to_pylist(), []
            for bucket, kind, data in zip(b.column("dest").to_pylist(), kinds, b.column("data"), strict=True):
                if kind == SEQUENCE:  # on its way to the others
                    cells.append(data.as_py())
                    continue
                if bucket != last:
                    last, known = bucket, {}
                steps, sizes, text = _unpack(data.as_py())
                text, ends = text.tobytes(), np.cumsum(sizes).tolist()
                out = []
                for s, e in zip([0, *ends[:-1]], ends, strict=True):
                    w = text[s:e]
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = one(w)
                    out.append(ids)
                flat = np.array([i for ids in out for i in ids], dtype)
                cells.append(_pack(steps, np.array([len(ids) for ids in out], "<u4"), flat))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in NAMES[:3]], pa.array(cells, pa.binary())], NAMES)

    return run


class Table:
    """The ids of a block's words, by the words' numbers."""

    def __init__(self, dtype: str):
        self.parts, self.dtype, self.flat, self.words = [], dtype, None, 0

    def add(self, data: bytes) -> None:
        steps, sizes, ids = _unpack(data)
        self.words += len(steps)
        self.parts.append((np.cumsum(steps.astype(np.int64)), sizes.astype(np.int64), ids))

    def look_up(self, seq: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words of a sequence one after the other, and where those of each document end."""
        if self.flat is None:
            numbers, each, ids = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64),) * 3
            self.parts = []
            self.start, self.size = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
            self.start[numbers], self.size[numbers] = np.cumsum(each) - each, each
            self.flat = ids.astype(np.int32)
        each = self.size[seq]
        ends = np.cumsum(each)
        at = np.repeat(self.start[seq] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)
        last = np.cumsum(sizes.astype(np.int64))
        return self.flat[at], np.append(0, ends)[last]


def _together(dtype: str, kind: pa.DataType):
    """The ids of documents by position. The rows of a block stand together, its words before its sequences."""

    def run(batches):
        last, table = None, Table(dtype)
        for b in batches:
            for block, kind_, doc_ids, data in zip(b.column("block").to_pylist(), b.column("kind").to_pylist(), b.column("doc_ids"), b.column("data"), strict=True):
                if block != last:
                    last, table = block, Table(dtype)
                if kind_ == WORDS:
                    table.add(data.as_py())
                    continue
                sizes, seq, n = _unbox(data.as_py())
                if table.words != int.from_bytes(n, "little"):
                    raise ValueError("the rows of the input came in another order when read again; write it as a table first")
                ids, ends = table.look_up(_unpack_numbers(seq), _unpack(sizes)[0])
                lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, ends), pa.int64()), pa.array(ids)).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids.as_py(), kind), lists], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, block_bytes: int = 32 << 20, id_col="doc_id", text_col="text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) of every document, as the merges of the rank file have it.

    decoded: with the column of `decode` too, made where the ids are put together, so that
    a task needs one Python worker instead of two.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    ranks = read_ranks(ranks_path)
    dtype = "<u2" if max(ranks.values()) < 2**16 else "<u4"
    shared = spark.sparkContext.broadcast(ranks)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    row = f"block long, kind int, doc_ids array<{kind}>, data binary"
    parts = docs.mapInArrow(lean(_split(pattern, block_bytes, 8 * shuffle_partitions(spark), arrow)), f"dest long, {row}")
    ids = parts.repartition("dest").sortWithinPartitions("dest").mapInArrow(lean(_merge(shared, pattern, dtype)), row)
    turns = ids.repartition("block").sortWithinPartitions("block", "kind")
    together, schema = _together(dtype, arrow), f"doc_id {kind}, ids array<int>"
    if not decoded:
        return turns.mapInArrow(lean(together), schema)
    back = _decoder(spark.sparkContext.broadcast((list(ranks.values()), list(ranks))), "ids")
    return turns.mapInArrow(lean(lambda batches: back(together(batches))), f"{schema}, decoded binary")


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with the column `decoded`: the bytes of the ids."""
    spark: SparkSession = encoded.sparkSession
    small_batches(spark)
    ranks = read_ranks(ranks_path)
    shared = spark.sparkContext.broadcast((list(ranks.values()), list(ranks)))
    schema = encoded.limit(0).select("*", F.lit(b"").alias("decoded")).schema
    return encoded.mapInArrow(lean(_decoder(shared, ids_col)), schema)


def _decoder(shared, ids_col: str):
    """Batches with the bytes of their ids. shared: ids and bytes of the token-byte table."""

    def run(batches):
        tokens, found = pa.array(shared.value[0], pa.int32()), pa.array(shared.value[1], pa.large_binary())
        for b in batches:
            lists = b.column(ids_col)
            row = pc.index_in(lists.flatten().cast(pa.int32()), tokens)  # the join: a hash table of the token ids, asked for every position
            if row.null_count:
                raise ValueError("there are ids that the token-byte table doesn't have")
            taken = found.take(row)
            ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
            flat = memoryview(taken.buffers()[2] or b"")
            at = ends[np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy()))].tolist()
            decoded = [bytes(flat[s:e]) if ok else None for s, e, ok in zip(at[:-1], at[1:], lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(decoded, pa.binary())], [*b.schema.names, "decoded"])

    return run
