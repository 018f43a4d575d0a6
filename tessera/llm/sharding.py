"""Sharding by histogram sort: byte-balanced, contiguous key ranges found by exact counting.

The key of a row is the upper half of a hash of its text followed by the upper half of a
hash of its id: equal texts are neighbours, and a group of copies of any size is still
spread over four billion keys. Probes between the known bounds of each splitter are
counted exactly over all rows, one aggregation a round, until the bytes below a splitter
meet the tolerance. Rows are then exchanged once, by their range.

A boundary between two shards keeps a group of equal texts whole where that costs at
most `group_slack` of a shard; a larger group is split between shards.

Defined results: a null text has no bytes, size 1 and checksum 0; rows with equal id and
text stay together, as one key; null ids are one id; an empty table gives an empty
result; there may be fewer documents than shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import shuffle_partitions, stored

LOW, HIGH, GROUP = -(2**63), 2**63 - 1, 2**32


def keyed(docs: DataFrame, id_col: str, text_col: str, columns: list[str]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    upper = F.xxhash64(text).bitwiseAND(F.lit(-GROUP))
    lower = F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 32)
    carried = [F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")] if columns else []
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), upper.bitwiseOR(lower).alias("key"), *carried,
    )


def below(rows: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with a key below each probe: each task adds up its own bins,
    and one row for each bin comes to the driver."""
    n = len(probes)

    def count(batches):
        size, rows_in = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for b in batches:
            at = np.searchsorted(probes, b.column("key").to_numpy(), side="right")
            np.add.at(size, at, b.column("size").to_numpy())
            rows_in += np.bincount(at, minlength=n + 1)
        some = np.flatnonzero(rows_in)
        yield pa.RecordBatch.from_pydict({"bin": pa.array(some.astype(np.int32)), "bytes": pa.array(size[some]), "n": pa.array(rows_in[some])})

    found = rows.select("key", "size").mapInArrow(count, "bin int, bytes long, n long").groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    size, rows_in = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for b, s, c in found.collect():
        size[b], rows_in[b] = s, c
    return np.cumsum(size)[:-1], np.cumsum(rows_in)[:-1]


class Splitter:
    """The key range that still holds a boundary, with exact counts at both ends."""

    def __init__(self, goal: float, tolerance: float, total: int, rows: int, whole: float | None):
        self.goal, self.tolerance, self.whole = goal, tolerance, whole
        self.unit = GROUP if whole is not None else 1
        self.low, self.high = (LOW, 0, 0), (HIGH, total, rows)

    def best(self) -> tuple[int, int, int]:
        return min(self.low, self.high, key=lambda e: abs(e[1] - self.goal))

    def done(self) -> bool:
        miss = abs(self.best()[1] - self.goal)
        if miss <= self.tolerance or self.high[2] - self.low[2] <= 1 and self.unit == 1:
            return True
        if self.high[0] - self.low[0] <= self.unit or self.high[2] - self.low[2] <= 1:
            if self.unit == 1 or miss <= self.whole:
                return True
            self.unit = 1  # a group larger than the slack: the boundary goes through it
            return self.high[0] - self.low[0] <= 1 or self.high[2] - self.low[2] <= 1
        return False

    def probes(self) -> list[int]:
        """Even steps, and points around where an even spread of bytes puts the goal."""
        width = self.high[0] - self.low[0]
        share = (self.goal - self.low[1]) / max(1, self.high[1] - self.low[1])
        steps = {i / 8 for i in range(1, 8)} | {share + d for d in (-1 / 16, -1 / 64, -1 / 512, 0, 1 / 512, 1 / 64, 1 / 16)}
        at = {self.low[0] + int(width * s) for s in steps if 0 < s < 1} | {self.low[0] + self.unit}
        return [p for p in {x - x % self.unit for x in at} if self.low[0] < p < self.high[0]]

    def learn(self, probe: int, size: int, rows: int) -> None:
        if self.low[0] < probe < self.high[0]:
            if size <= self.goal:
                self.low = (probe, size, rows)
            else:
                self.high = (probe, size, rows)


def splitters(rows: DataFrame, shards: int, per_shard: int, tolerance: float, group_slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece boundaries, the shard of each piece and the rows of the shard before it."""
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    pieces, share = shards * per_shard, total / shards
    every = [
        Splitter(total * i / pieces, share * tolerance, total, n, share * group_slack) if i % per_shard == 0
        else Splitter(total * i / pieces, share / per_shard * 0.25, total, n, None)
        for i in range(1, pieces)
    ]
    while open_ := [s for s in every if not s.done()]:
        probes = sorted({p for s in open_ for p in s.probes()})
        if not probes:
            break
        size, rows_in = below(rows, np.array(probes, np.int64))
        for s in open_:  # the probes next to the goal tell all
            at = int(np.searchsorted(size, s.goal, side="right"))
            for i in range(max(0, at - 1), min(len(probes), at + 1)):
                s.learn(probes[i], int(size[i]), int(rows_in[i]))
    found = [s.best() for s in every]
    for i in range(1, len(found)):
        found[i] = max(found[i], found[i - 1], key=lambda e: e[0])
    shard = np.arange(pieces) // per_shard
    start = np.array([0] + [f[2] for f in found], np.int64)
    return np.array([f[0] for f in found], np.int64), shard.astype(np.int32), start - start[shard * per_shard]


def shard_documents(docs: DataFrame, shards: int = 16, tolerance: float = 0.001, group_slack: float = 0.02, columns: list[str] | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (and `row`, a struct of the `columns` asked for).

    Slots are gapless from 0 and follow the key. Each shard is sorted in as many pieces
    as the session's shuffle partitions allow for, so that no shard needs to fit one task.
    """
    narrow = stored(keyed(docs, id_col, text_col, []))
    per_shard = max(1, -(-shuffle_partitions(docs.sparkSession) // shards))
    bounds, shard, before = splitters(narrow, shards, per_shard, tolerance, group_slack)

    def place(batches):
        for b in batches:
            piece = np.searchsorted(bounds, b.column("key").to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(piece.astype(np.int32)), pa.array(shard[piece]), pa.array(before[piece])], [*b.schema.names, "piece", "shard", "before"])

    rows = keyed(docs, id_col, text_col, columns) if columns else narrow
    schema = rows.limit(0).select("*", F.lit(0).alias("piece"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("before")).schema
    rows = rows.mapInArrow(place, schema)
    inside = F.row_number().over(W.partitionBy("piece").orderBy("key", "doc_id", "text_crc32", "size"))
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + inside - 1).cast("long").alias("slot"), *(["row"] if columns else []))
