"""Operator 7, best-fit packing of documents into sequences of a fixed capacity.

Only the number of pieces of each length matters for a plan, so a histogram of at most `capacity` rows
goes to the driver. Pieces above a third of the capacity are matched greedily, at most two to a bin,
the largest with the largest that fits; smaller ones go, largest first, to the smallest gap that holds
them. The plan says which ranks of a length go to which bins; ranks come from counts of each partition.
A plan has a few steps for each length (a step uses up a length or a group of like bins), so what is
broadcast is bounded by the capacity. Null counts as empty text. Ties and repeated rows only differ in
rank. Extra columns are dropped.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolap.llm import scratch, words

PIECES = "doc_id long, piece int, start long, length long, ids binary"
ENTRIES, POOL = 1 << 19, 1 << 22
_CUT = np.ones(256, dtype=bool)
_CUT[[0x20, 0x0A]] = False
_LOADED: dict[str, tuple] = {}


class Memo:
    """Ids of words by 64-bit hash: at most ENTRIES words and POOL ids; the words not met for longest go first."""

    def __init__(self) -> None:
        self.keys, self.at, self.size, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.now = np.zeros(0, np.uint32), 0

    def missing(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.ones(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] != keys

    def add(self, keys: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Sorted keys that are missing, and their ids one after another."""
        if len(self.keys) + len(keys) > ENTRIES or len(self.pool) + len(ids) > POOL:
            keep = (self.used > np.median(self.used)) | (self.used == self.now) if len(self.used) else np.zeros(0, bool)  # those of this part stay
            at, n = self.at[keep], self.size[keep]
            self.pool = self.pool[_ranges(at, n)]
            self.keys, self.size, self.used, self.at = self.keys[keep], n, self.used[keep], np.cumsum(n) - n
        to = np.searchsorted(self.keys, keys)
        self.at = np.insert(self.at, to, len(self.pool) + np.cumsum(size) - size)
        self.size, self.used, self.keys = np.insert(self.size, to, size), np.insert(self.used, to, self.now), np.insert(self.keys, to, keys)
        self.pool = np.concatenate([self.pool, ids])

    def touch(self, keys: np.ndarray) -> None:
        """Keys that are there are met now."""
        self.now += 1
        self.used[np.searchsorted(self.keys, keys)] = self.now

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of keys that are there begin in the pool, and how many they are."""
        p = np.searchsorted(self.keys, keys)
        return self.at[p], self.size[p]


def _ranges(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... (n[0] of them), at[1], ..."""
    return np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _load(path: str) -> tuple:
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _LOADED[path] = t, Memo()
    return _LOADED[path]


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Token ids of each document and end_id, cut into pieces of the capacity.

    The tokenizer drops white space and never joins across it, so each word between spaces or line feeds
    is encoded once and kept by its hash in a table of bounded size; texts are put together from it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, memo = _load(path)
        for b in words.parts(batches, "text", 4 << 20):
            raw, offsets = words.buffers(b.column(1))
            starts, ends, first = words.spans(raw, offsets, _CUT)
            h, at, of = np.unique(words.hashes(raw, starts, ends), return_index=True, return_inverse=True)
            if len(h) > ENTRIES // 2:  # a part with more words than the table may hold gets one of its own
                memo = Memo()
            lost = np.flatnonzero(memo.missing(h))
            got = [e.ids for i in range(0, len(lost), 20_000) for e in t.encode_batch_fast([raw[starts[k] : ends[k]].tobytes().decode() for k in at[lost[i : i + 20_000]].tolist()], add_special_tokens=False)]
            size = np.fromiter(map(len, got), np.int64, len(got))
            memo.touch(np.delete(h, lost))
            memo.add(h[lost], size, np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum())))
            where, n = memo.get(h)
            where, n = where[of], n[of]
            per = np.diff(np.r_[0, np.cumsum(n)][first])  # ids of each text
            ids = np.empty(int(per.sum()) + len(per), np.uint32)
            total = np.cumsum(per + 1)
            mine = np.ones(len(ids), bool)
            mine[total - 1] = False
            ids[mine] = memo.pool[_ranges(where, n)]
            ids[total - 1] = end_id
            count = -(-(per + 1) // capacity)
            row = np.repeat(np.arange(len(per)), count)
            piece = _ranges(np.zeros(len(per), np.int64), count)
            length = np.minimum(capacity, (per + 1)[row] - piece * capacity)
            cut = np.r_[0, np.cumsum(length)].astype(np.int32) * np.int32(4)
            binary = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), binary], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first bin, pieces of it in a bin, offset) for every piece counted."""
    left = {k: n for k, n in counts.items() if n > 0}
    ranks = dict.fromkeys(left, 0)
    out, groups, bins = [], [], 0  # groups: (gap, first bin, bins)

    def put(size: int, first: int, n: int, each: int, offset: int) -> None:
        out.append((size, ranks[size], ranks[size] + n, first, each, offset))
        ranks[size] += n
        left[size] -= n

    large = sorted(k for k in left if 3 * k > capacity)
    for a in reversed(large):
        while left[a]:
            fit = [b for b in large[: bisect.bisect_right(large, min(a, capacity - a))] if left[b]]
            b = fit[-1] if fit else None
            if b == a and left[a] == 1:
                b = fit[-2] if len(fit) > 1 else None
            if b is None:
                n, gap = left[a], capacity - a
                put(a, bins, n, 1, 0)
            elif b == a:
                n, gap = left[a] // 2, capacity - 2 * a
                put(a, bins, 2 * n, 2, 0)
            else:
                n, gap = min(left[a], left[b]), capacity - a - b
                put(a, bins, n, 1, 0)
                put(b, bins, n, 1, a)
            if gap:
                groups.append((gap, bins, n))
            bins += n
    groups.sort()
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[s]:
            i = bisect.bisect_left(groups, (s, -1, -1))
            if i == len(groups):
                n = -(-left[s] // (capacity // s))
                groups.append((capacity, bins, n))
                bins += n
            gap, first, n = groups.pop(i)
            each = min(gap // s, left[s])
            full = min(n, left[s] // each)
            put(s, first, full * each, each, capacity - gap)
            if gap - each * s:
                bisect.insort(groups, (gap - each * s, first, full))
            if n > full:
                bisect.insort(groups, (gap, first + full, n - full))
    return out


def pack(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """items (any columns, and length from 1 to capacity) with sequence_id and offset; bins have no gaps."""
    spark = items.sparkSession
    kept = items.columns
    schema = items.withColumn("_part", F.lit(0)).withColumn("_rank", F.lit(0).cast("long")).schema

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            n = b.column(b.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(n, kind="stable")
            s = n[order]
            start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
            r = np.empty(len(n), np.int64)
            r[order] = np.arange(len(s)) - np.repeat(start, np.diff(np.r_[start, len(s)])) + seen[s]
            np.add.at(seen, n, 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(r)], names=[*b.schema.names, "_part", "_rank"])

    # two steps, so that a task has one Python worker at a time
    ranked = scratch.write(scratch.write(items, "items").mapInArrow(rank, schema), "pieces")
    counted = ranked.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = counted.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    counts = {r[0]: r[1] for r in ranked.groupBy("length").count().collect()}  # at most `capacity` rows
    rows = plan(counts, capacity)
    by: dict[int, list[tuple]] = {}
    for x in rows:
        by.setdefault(x[0], []).append(x[1:])
    steps = spark.createDataFrame([(k, [tuple(map(int, y)) for y in sorted(v)]) for k, v in by.items()], "length long, _steps array<struct<a:long,b:long,bin:long,each:long,at:long>>")
    joined = ranked.join(before.select("length", "_part", F.coalesce("_before", F.lit(0)).alias("_before")), ["length", "_part"]).join(F.broadcast(steps), "length")
    s = joined.withColumn("_r", F.col("_rank") + F.col("_before")).withColumn("_s", F.expr("filter(_steps, x -> x.a <= _r and _r < x.b)[0]"))
    return s.select(*kept, F.expr("_s.bin + (_r - _s.a) div _s.each").alias("sequence_id"), F.expr("_s.at + (_r - _s.a) % _s.each * length").alias("offset"))


def query(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    p = pieces(docs, path, capacity).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(p, capacity)
