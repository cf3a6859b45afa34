"""Operator 6, line dedup by an exact set-similarity join of line tokens at Jaccard 0.8.

Lines are parts between line feeds; a line's set holds its lower-cased (A-Z) words. A line goes when an
earlier line (smaller doc_id, then place) has a similarity of 0.8 or more; lines without words stay.
Tokens are ordered by rarity: counts of all words are summed by hash in CELLS cells (so what every task
knows has a fixed bound), and rarer cells come first. Lines of equal sets are one class, reduced in each
task first; the earliest stands for it. Prefix, length and positional filters and a 128-bit parity sketch
(each differing token flips one bit) leave candidates, verified on whole sets: first the closest by sketch
of the LOOK earliest of a line and prefix token, then the others of those, then, for lines still open that
have more, all earlier ones of the token, in blocks of BLOCK by BLOCK lines that give only verified lines.
A null doc_id counts as the smallest; null text stays null and empty text empty. Rows with the same doc_id
are told apart by their lines: lines with the same doc_id, place and set count as one, so a row repeated
as it is keeps what its twin keeps. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolap.llm import blobs, scratch, words

CELLS, RANGES, LOOK, BLOCK, SEEN, BITS = 1 << 21, 64, 8, 1024, 1 << 17, 1 << 24
NO_ID = -(2**63)
_RECORD = np.dtype([("token", "<u4"), ("a", "<u8"), ("x", "<u8"), ("y", "<u8"), ("doc", "<i8"), ("line", "<i4"), ("size", "<i4"), ("pos", "<i4")])
_CELL = np.dtype([("cell", "<u4"), ("n", "<u4")])
LINE = "doc long, line int, a long"
PAIR = f"kind int, {LINE}, doc0 long, line0 int, a0 long"


def token_counts(docs: DataFrame) -> DataFrame:
    """(h, n): occurrences of every word hash, added up in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for p in words.parts(batches, "text"):
            h, n = np.unique(words.Words(p.column(0)).h, return_counts=True)
            h, i = np.unique(np.r_[have[0], h], return_inverse=True)
            have = h, np.bincount(i, weights=np.r_[have[1], n], minlength=len(h)).astype(np.int64)
            if len(h) > 2_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(have[0].view(np.int64)), pa.array(have[1])], names=["h", "n"])
                have = have[0][:0], have[1][:0]
        yield pa.RecordBatch.from_arrays([pa.array(have[0].view(np.int64)), pa.array(have[1])], names=["h", "n"])

    return docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(43)).astype(np.int64)


def levels(docs: DataFrame) -> np.ndarray:
    """For each cell the logarithm of its count over all documents, in eighths, as one byte."""
    step = CELLS // RANGES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for p in words.parts(batches, "text"):
            total += np.bincount(cells(words.Words(p.column(0)).h), minlength=CELLS)
        at = np.flatnonzero(total)
        r = np.empty(len(at), _CELL)
        r["cell"], r["n"] = at, np.minimum(total[at], 2**32 - 1)
        cut = np.searchsorted(at, np.arange(RANGES + 1) * step)
        some = [k for k in range(RANGES) if cut[k] < cut[k + 1]]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([blobs._bytes(r[cut[k] : cut[k + 1]]) for k in some], pa.binary())], names=["bucket", "records"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in blobs.unpack(batches, _CELL):
            k = int(r["cell"][0]) // step
            n = np.bincount(r["cell"].astype(np.int64) - k * step, weights=r["n"], minlength=step)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.minimum(255, 8 * np.log2(1 + n)).astype(np.uint8).tobytes()], pa.binary())], names=["bucket", "records"])

    out = np.zeros(CELLS, np.uint8)
    for k, b in blobs.dealt(docs.select("text").mapInArrow(count, blobs.SCHEMA)).mapInArrow(add, blobs.SCHEMA).collect():  # CELLS bytes
        out[k * step : (k + 1) * step] = np.frombuffer(b, np.uint8)
    return out


def prefix(size: np.ndarray | int) -> np.ndarray | int:
    """Prefix length for Jaccard 0.8: size - ceil(0.8 * size) + 1."""
    return size - (4 * size + 4) // 5 + 1


class Sets:
    """The lines with words of a batch of texts: row, place, and sorted distinct tokens h[at[k]:at[k] + size[k]]."""

    def __init__(self, column: pa.Array, level: np.ndarray | None = None):
        w = words.Words(column)
        feeds = np.cumsum(w.low == 10, dtype=np.int32)
        line = feeds[w.starts] if len(w.starts) else np.zeros(0, np.int32)
        row = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        begin = w.offsets[:-1]
        before = np.where(begin > 0, feeds[np.maximum(begin, 1) - 1], 0) if len(feeds) else np.zeros(len(begin), np.int32)
        line = line - before[row]
        new = np.r_[True, (row[1:] != row[:-1]) | (line[1:] != line[:-1])][: len(row)]
        group = np.cumsum(new, dtype=np.int64) - 1
        self.row, self.line = row[new], line[new].astype(np.int32)
        self.h, g = self._sorted(w.h, group, level)
        self.at = np.flatnonzero(np.r_[True, g[1:] != g[:-1]][: len(g)])
        self.size = np.diff(np.r_[self.at, len(g)]).astype(np.int32)
        m = words.mix(self.h)
        self.a = words.mix(np.add.reduceat(m, self.at) + self.size.astype(np.uint64)) if len(g) else m

    @staticmethod
    def _sorted(h: np.ndarray, group: np.ndarray, level: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct tokens of each group from rare to frequent, then by hash."""
        if not len(h):
            return h, group
        rank = np.zeros(len(h), np.uint64) if level is None else level[cells(h)].astype(np.uint64)
        bits = max(1, int(group[-1]).bit_length())
        key = (group.astype(np.uint64) << np.uint64(64 - bits)) | (rank << np.uint64(56 - bits)) | (h >> np.uint64(8 + bits))
        o = np.argsort(key)
        k, g, s = key[o], group[o], h[o]
        if ((k[1:] == k[:-1]) & (s[1:] != s[:-1])).any():  # different tokens of one key
            o = np.lexsort((h, key))
            g, s = group[o], h[o]
        new = np.r_[True, (g[1:] != g[:-1]) | (s[1:] != s[:-1])]
        return s[new], g[new]

    def sketches(self) -> tuple[np.ndarray, np.ndarray]:
        m = words.mix(self.h + np.uint64(5))
        bit, side = np.uint64(1) << (m & np.uint64(63)), ((m >> np.uint64(6)) & np.uint64(1)).astype(bool)
        zero = np.uint64(0)
        return np.bitwise_xor.reduceat(np.where(side, zero, bit), self.at), np.bitwise_xor.reduceat(np.where(side, bit, zero), self.at)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _rows(kind: int, doc, line, a, doc0=None, line0=None, a0=None) -> pa.RecordBatch:
    zero = np.zeros(len(doc), np.int64)
    get = lambda v, t: pa.array(np.ascontiguousarray(zero if v is None else v.view(np.int64) if v.dtype == np.uint64 else v).astype(t))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), get(doc, np.int64), get(line, np.int32), get(a, np.int64), get(doc0, np.int64), get(line0, np.int32), get(a0, np.int64)], names=["kind", "doc", "line", "a", "doc0", "line0", "a0"])


def postings(docs: DataFrame, level: np.ndarray, buckets: int) -> DataFrame:
    """Blobs of prefix records of the lines; lines with the set of an earlier one of their task come in buckets below 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[dict] = [{}, {}]  # sets of this task: the earliest line of each; a full table becomes the old one
        for p in words.parts(batches, "text", 4 << 20):
            s = Sets(p.column(1), level)
            if not len(s.at):
                continue
            x, y = s.sketches()
            doc = _ids(p.column(0))[s.row]
            again = np.zeros(len(doc), bool)
            # sets that come more than once in a part are looked for in the parts after it
            by = np.lexsort((s.line, doc, x, s.a))
            same = np.r_[False, (s.a[by][1:] == s.a[by][:-1]) & (x[by][1:] == x[by][:-1])]
            again[by[same]] = True
            often = np.zeros(len(doc), bool)
            often[by[np.flatnonzero(same[1:] & ~same[:-1])]] = True
            if len(seen[0]) > SEEN:
                seen = [{}, seen[0]]
            now, old = seen
            known = np.fromiter((k[0] for k in (*now, *old)), np.uint64, len(now) + len(old))
            for i in np.flatnonzero((often | np.isin(s.a, known)) & ~again).tolist():
                k, mine = (int(s.a[i]), int(x[i])), (int(doc[i]), int(s.line[i]))
                first = now.get(k) or old.get(k)
                if first is not None and first < mine:
                    again[i], now[k] = True, first
                elif often[i] or first is not None:
                    now[k] = mine
            if again.any():
                d = np.empty(int(again.sum()), [("doc", "<i8"), ("line", "<i4"), ("a", "<u8")])
                d["doc"], d["line"], d["a"] = doc[again], s.line[again], s.a[again]
                yield pa.RecordBatch.from_arrays([pa.array([-1 - int(s.a[0] % np.uint64(buckets))], pa.int32()), pa.array([blobs._bytes(d)], pa.binary())], names=["bucket", "records"])
            n = np.where(again, 0, prefix(s.size))
            k = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
            token = words.mix(s.h[s.at[k] + pos])
            r = np.empty(len(k), _RECORD)
            for name, v in (("token", token & np.uint64(2**32 - 1)), ("a", s.a[k]), ("x", x[k]), ("y", y[k]), ("doc", doc[k]), ("line", s.line[k]), ("size", s.size[k]), ("pos", pos)):
                r[name] = v
            yield from blobs.pack(r, token, buckets)

    return docs.select("doc_id", "text").mapInArrow(run, blobs.SCHEMA)


def candidates(r: np.ndarray, look: int = LOOK) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For the records of a bucket, sorted by token, doc, line: group starts, ranks, the closest of the `look` earliest candidates of each (-1: none), all of those pairs (later, earlier), and which have more to try."""
    start = np.searchsorted(r["token"], r["token"]) if len(r) else np.zeros(0, np.int64)
    rank, count = np.arange(len(r)) - start, np.zeros(len(r), np.int32)
    size, pos, x, y = (np.ascontiguousarray(r[k]) for k in ("size", "pos", "x", "y"))
    best, least = np.full(len(r), -1), np.full(len(r), 1 << 30, np.int32)
    more, out = np.zeros(len(r), bool), []
    live = np.argsort(-rank, kind="stable")  # those of the highest rank first, so the ones with an e-th record are a head
    above, low, high, first = -rank[live], (4 * size[live] + 4) // 5, 5 * size[live] // 4, start[live]
    e = ended = 0
    while n := int(np.searchsorted(above, -e)):
        s = size[first[:n] + e]
        k = np.flatnonzero((s >= low[:n]) & (s <= high[:n]))
        i, j = first[k] + e, live[k]
        s, t, p, q = s[k], size[j], pos[i], pos[j]
        need = (4 * (s + t) + 8) // 9
        k = np.flatnonzero((1 + np.minimum(s - p - 1, t - q - 1) + np.minimum(p, q) >= need) & ~more[j])
        i, j, far = i[k], j[k], (s + t - 2 * need)[k]
        d = np.bitwise_count(x[i] ^ x[j]).astype(np.int32) + np.bitwise_count(y[i] ^ y[j])
        ok = d <= far
        if ok.any():
            i, j, d = i[ok], j[ok], d[ok]
            count[j] += 1
            near = d < least[j]
            best[j[near]], least[j[near]] = i[near], d[near]
            out.append((j, i))
            full = j[(count[j] == look) & (rank[j] > e + 1)]
            more[full] = True
            ended += len(full)
            if 8 * ended > n:
                keep = ~more[live]
                live, above, low, high, first = live[keep], above[keep], low[keep], high[keep], first[keep]
                ended = 0
        e += 1
    return start, rank, best, out, more


def classes(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest record of each token and set, by token, doc and line, and the others."""
    key = (r["token"].astype(np.uint64) << np.uint64(32)) | (r["a"] >> np.uint64(32))
    o = np.argsort(key)
    k, a = key[o], r["a"][o]
    if ((k[1:] == k[:-1]) & (a[1:] != a[:-1])).any():
        o = np.lexsort((r["a"], key))
        a = r["a"][o]
        k = key[o]
    new = np.r_[True, (k[1:] != k[:-1]) | (a[1:] != a[:-1])][: len(o)]
    group = np.cumsum(new) - 1
    several = np.bincount(group)[group] > 1 if len(o) else new
    first, others = o[~several], o[:0]
    if several.any():
        g, m = group[several], o[several]
        by = np.lexsort((r["line"][m], r["doc"][m], g))
        g, m = g[by], m[by]
        head = np.r_[True, g[1:] != g[:-1]]
        first, others = np.r_[first, m[head]], m[~head]
        lead = m[np.maximum.accumulate(np.where(head, np.arange(len(m)), 0))][~head]
        others = others[(r["doc"][others] != r["doc"][lead]) | (r["line"][others] != r["line"][lead])]
    return r[first], r[others]


def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: a line with the set of an earlier one; 1: a line and its closest candidate; 3: and another one; 2: the lines of a token with more to try (line0 its rank, doc0 the token's name, a0 whether it has more)."""
    for r in blobs.unpack(batches, _RECORD):
        r, d = classes(r)
        d = d[d["pos"] == 0]  # equal sets have equal prefixes
        if len(d):
            yield _rows(0, d["doc"], d["line"], d["a"])
        t = np.sort(r["token"])
        t = t[1:][t[1:] == t[:-1]]
        r = r[np.isin(r["token"], t)]
        r = r[np.lexsort((r["line"], r["doc"], r["token"]))]
        start, rank, best, found, more = candidates(r)
        if not found:
            continue
        j, i = (np.concatenate(x) for x in zip(*found))
        closest = best[j] == i
        by = np.argsort(~closest, kind="stable")
        j, i, closest = j[by], i[by], closest[by]
        _, one = np.unique(words.mix(r["a"][j]) + r["a"][i], return_index=True)  # one of each pair of sets, if closest then as that
        for kind, k in ((1, one[closest[one]]), (3, one[~closest[one]])):
            for at in range(0, len(k), 1 << 16):
                x, y = r[j[k[at : at + (1 << 16)]]], r[i[k[at : at + (1 << 16)]]]
                yield _rows(kind, x["doc"], x["line"], x["a"], y["doc"], y["line"], y["a"])
        if more.any():
            m = np.flatnonzero(np.isin(start, start[more]))
            x = r[m]
            name = words.mix(x["token"].astype(np.uint64) + (r["a"][start[m]] << np.uint64(1)))
            yield _rows(2, x["doc"], x["line"], x["a"], name, rank[m], more[m].astype(np.int64))


def _blobs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of binary rows one after another, and how many each has."""
    off = np.frombuffer(column.buffers()[1], np.int32, count=len(column) + 1, offset=4 * column.offset)
    data = column.buffers()[2]
    h = np.frombuffer(data, np.uint64, count=(off[-1] - off[0]) // 8, offset=int(off[0])) if len(column) and off[-1] > off[0] else np.zeros(0, np.uint64)
    return h, np.diff(off) // 8


def _checked(t: pa.Table) -> list[int]:
    """The late rows of a group that an early one with a smaller o is like."""
    late, o = t["late"].to_numpy(), t["o"].to_numpy()
    first = np.flatnonzero(~late)
    if not len(first) or late.sum() == 0:
        return []
    h, size = _blobs(t["s"].combine_chunks())
    start = np.cumsum(size) - size
    h, at = np.unique(h, return_inverse=True)
    mine = np.concatenate([at[start[k] : start[k] + size[k]] for k in first])
    cut, n, hit, out = np.cumsum(size[first]) - size[first], size[first], np.zeros(len(h), np.int32), []
    for k in np.flatnonzero(late):
        p = at[start[k] : start[k] + size[k]]
        hit[p] = 1
        x = np.add.reduceat(hit[mine], cut)
        hit[p] = 0
        if ((10 * x >= 8 * (n + size[k] - x)) & (o[first] < o[k])).any():
            out.append(int(k))
    return out


def verified(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, line, a) of the late lines that an early one of their group (g, ob, mb) with a smaller o is like, on whole sets."""
    keys = ["g", "ob", "mb"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in words.parts(batches, "text", 4 << 20):
            s, doc, want = Sets(p.column(1)), p.column(0).to_numpy(), p.column(2)
            row = np.repeat(np.arange(len(want)), want.value_lengths().to_numpy())
            w = want.flatten()
            name = lambda row, line, a: words.mix(words.mix(row.astype(np.uint64) << np.uint64(32) | line.astype(np.uint64)) + a)
            have = name(s.row, s.line, s.a)
            by = np.argsort(have)
            need = name(row, w.field(0).to_numpy(), w.field(1).to_numpy().view(np.uint64))
            at = np.minimum(np.searchsorted(have[by], need), max(0, len(have) - 1))
            ok = np.flatnonzero(have[by][at] == need) if len(have) else np.zeros(0, np.int64)  # else of another text of the doc_id
            k = by[at[ok]] if len(have) else ok
            for i in range(0, len(ok), 4096):
                x, y = w.take(pa.array(ok[i : i + 4096])), k[i : i + 4096]
                yield pa.RecordBatch.from_arrays([x.field(2), x.field(3), x.field(4), x.field(5), x.field(6), pa.array(doc[s.row[y]]), x.field(0), x.field(1), pa.array([s.h[s.at[j] : s.at[j] + s.size[j]].tobytes() for j in y], pa.binary())], names=[*keys, "o", "late", "doc", "line", "a", "s"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def end() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held)
                if found := _checked(t):
                    yield from t.take(pa.array(found, pa.int64())).select(["doc", "line", "a"]).combine_chunks().to_batches()

        for b in batches:
            k = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
            at = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
            for i, j in zip(at[:-1], at[1:]):
                if j > i:
                    if key != (now := tuple(k[i].tolist())):
                        yield from end()
                        held.clear()
                        key = now
                    held.append(b.slice(i, j - i))
        yield from end()

    wanted = scratch.write(wanted, "wanted")
    by = wanted.groupBy("doc").agg(F.collect_set(F.struct("line", "a", *keys, "o", "late")).alias("want"))
    # Most documents have no wanted line: BITS bits, set by hash, keep their texts out of the shuffle. The size
    # of what is broadcast is fixed; where most bits are set, more texts travel and the result is the same.
    slot = F.pmod(F.xxhash64("doc"), F.lit(BITS))
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    bits = wanted.select("doc").distinct().select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("w")).agg(F.bit_or(bit).alias("bits"))
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text").withColumn("slot", slot).withColumn("w", F.expr("slot div 64"))
    texts = texts.join(F.broadcast(bits), "w").where(F.col("bits").bitwiseAND(bit) != 0).select("doc", "text")
    sent = texts.join(by, "doc").select("doc", "text", "want").mapInArrow(sets, f"g long, ob long, mb long, o long, late boolean, {LINE}, s binary")
    return sent.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(check, LINE).distinct()


def _paired(pairs: DataFrame) -> DataFrame:
    """Pairs as groups of an earlier line and at most BLOCK later ones."""
    pairs = pairs.distinct().withColumn("g", F.xxhash64("doc0", "line0", "a0"))
    part = F.row_number().over(Window.partitionBy("g").orderBy("doc", "line"))
    pairs = pairs.withColumn("ob", (part / BLOCK).cast("long")).withColumn("mb", F.lit(-1).cast("long"))
    key = ["g", "ob", "mb"]
    early = pairs.select(*key, F.lit(0).cast("long").alias("o"), F.lit(False).alias("late"), F.col("doc0").alias("doc"), F.col("line0").alias("line"), F.col("a0").alias("a")).distinct()
    return early.union(pairs.select(*key, F.lit(1).cast("long"), F.lit(True), "doc", "line", "a"))


def _blocked(member: DataFrame, open_: DataFrame) -> DataFrame:
    """The lines of the tokens of open lines, as groups of a block of open lines and a block of earlier ones."""
    line = ["doc", "line", "a"]
    div = (F.col("o") / BLOCK).cast("long")
    later = member.where("more").join(open_, line, "left_semi").select("g", "o", *line, div.alias("ob"))
    last = later.groupBy("g").agg(F.max("o").alias("last"), F.collect_set("ob").alias("obs"))
    early = member.join(last, "g").where("o < last").select("g", F.explode("obs").alias("ob"), div.alias("mb"), "o", F.lit(False).alias("late"), *line)
    side = later.select("g", "ob", F.explode(F.expr("sequence(0L, ob)")).alias("mb"), "o", F.lit(True).alias("late"), *line)
    return early.where("mb <= ob").union(side)


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc, line, a) of every line that an earlier one is like; lines count from 0, a names the line's set."""
    spark = docs.sparkSession
    level = levels(docs)
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    line = ["doc", "line", "a"]
    again = np.dtype([("doc", "<i8"), ("line", "<i4"), ("a", "<u8")])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The join, and as kind 0 what postings() found already."""
        done: list[pa.RecordBatch] = []

        def others() -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = b.column(0).to_numpy() < 0
                for blob in b.column(1).filter(pa.array(own)).to_pylist():
                    d = blobs._array(blob, again)
                    done.append(_rows(0, d["doc"], d["line"], d["a"]))
                yield b.filter(pa.array(~own))

        for out in join(others()):
            yield from done
            done.clear()
            yield out
        yield from done

    found = scratch.write(blobs.dealt(postings(docs, level, buckets)).mapInArrow(joined, PAIR), "candidates")
    pair = [*line, "doc0", "line0", "a0"]
    gone = scratch.write(found.where("kind = 0").select(*line).union(verified(docs, _paired(found.where("kind = 1").select(*pair)))).distinct(), "removed")
    open_ = scratch.write(found.where("kind = 3 or kind = 2 and a0 > 0").select(*line).distinct().join(gone, line, "left_anti"), "open")
    if open_.limit(1).count():
        others = found.where("kind = 3").select(*pair).join(open_, line, "left_semi")
        member = found.where("kind = 2").select(F.col("doc0").alias("g"), F.col("line0").cast("long").alias("o"), *line, (F.col("a0") > 0).alias("more"))
        gone = gone.union(scratch.write(verified(docs, _paired(others).union(_blocked(member, open_))), "removed_later"))
    scratch.drop(found, open_)
    return gone


def remove_lines(docs: DataFrame) -> DataFrame:
    """The columns of docs as c0, c1, ..., the text without the removed lines; n_lines, removed (places) and emptied."""
    gone = removed_lines(docs).groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("line", "a"))).alias("gone"))
    i, n = docs.columns.index("text"), len(docs.columns)
    plain = docs.toDF(*[f"c{k}" for k in range(n)])
    key = F.coalesce(F.col(f"c{docs.columns.index('doc_id')}"), F.lit(NO_ID))
    several = plain.withColumn("doc", key).withColumn("several", F.count("*").over(Window.partitionBy("doc")) > 1)
    both = several.join(gone, "doc", "left").drop("doc")
    schema = plain.selectExpr("*", "0L as n_lines", "array(0) as removed", "true as emptied").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.parts(batches, f"c{i}", 4 << 20):
            text = b.column(i)
            now, removed, emptied = {}, [[]] * b.num_rows, np.zeros(b.num_rows, bool)
            at = np.flatnonzero(b.column(n + 1).is_valid().to_numpy(zero_copy_only=False))
            own = b.column(n).to_pylist()
            for k, t, want in zip(at.tolist(), text.take(pa.array(at)).to_pylist(), b.column(n + 1).take(pa.array(at)).to_pylist()):
                if own[k]:  # several rows have this doc_id: the lines of another text are told by their sets
                    s = Sets(text.slice(k, 1))
                    mine = set(zip(s.line.tolist(), s.a.view(np.int64).tolist()))
                    want = [x for x in want if (x["line"], x["a"]) in mine]
                if want:
                    drop = {x["line"] for x in want}
                    now[k] = "\n".join(x for j, x in enumerate(t.split("\n")) if j not in drop)
                    removed[k], emptied[k] = sorted(drop), not now[k].strip(" \t\n\x0b\x0c\r")
            lines = pa.compute.add(pa.compute.count_substring(text, "\n"), 1).fill_null(0).cast(pa.int64())
            columns = list(b.columns)[:n]
            if now:
                mask = np.zeros(b.num_rows, bool)
                mask[list(now)] = True
                columns[i] = pa.compute.replace_with_mask(text, pa.array(mask), pa.array([now[k] for k in sorted(now)], text.type))
            yield pa.RecordBatch.from_arrays([*columns, lines, pa.array(removed, pa.list_(pa.int32())), pa.array(emptied)], names=[*b.schema.names[:n], "n_lines", "removed", "emptied"])

    return both.mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    return remove_lines(docs.select("doc_id", "text")).select(F.col("c0").alias("doc_id"), "n_lines", F.size("removed").cast("long").alias("n_removed"), F.col("removed").alias("removed_lines"), F.col("c1").alias("text"))


def stage(docs: DataFrame) -> DataFrame:
    """The documents without removed lines; one that loses all its words goes."""
    return remove_lines(docs).where("not emptied").drop("n_lines", "removed", "emptied").toDF(*docs.columns)
