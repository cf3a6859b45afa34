"""Operator 5, near-duplicate passages by compact windows, verified and removed after the first.

Tokens are shingles of SHINGLE words. For each of HASHES functions the Cartesian tree of the token hashes,
cut where fewer than LEAST tokens remain, gives the compact windows: all passages inside [lo, hi) that
contain the centre share its min-hash. Windows of equal value and equal tokens are one class: the tokens
of each but the earliest repeat it and are found. The classes of a value meet by the intervals of REACH
tokens around their centres: each is compared with the earliest class of its value and then, as long as
any of its tokens is not yet found, with every earlier class that holds such a token. In a comparison a
token is a hit if the earlier class has it within DRIFT places of the same distance to the centre; where
0.8 or more of LEAST tokens in a row are hits, these are found, from the first hit to the last. Earlier:
the smaller doc_id, then the place. So an exact repeat of LEAST tokens (50 words) is always found, and one at
a similarity of 0.8 with a chance of 1 - 0.2 ** HASHES for each of its stretches.
Words of found passages are removed with the white space after each; the rest stays as it is. Null, empty
and short texts keep all words, as do rows without a doc_id, which are compared with none. Rows with the
same doc_id are told apart by their texts; a row repeated as it is counts as one and is cut like its twin.
In a run of equal words every sixteenth window stands for those between. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolap.llm import blobs, scratch, words

SHINGLE, LEAST, HASHES = 5, 46, 4
REACH, DRIFT, SHARE, EVERY, SEEN = LEAST - 1, 10, 0.8, 16, 1 << 18
FAR, WIDE = REACH + DRIFT, 2 * (REACH + DRIFT) + 1
_RECORD = np.dtype([("v", "<u8"), ("k", "<u8"), ("doc", "<i8"), ("key", "<u4"), ("lo", "<i4"), ("c", "<i4"), ("hi", "<i4")])
_NEAR = np.dtype([("v", "<u8"), ("doc", "<i8"), ("key", "<u4"), ("c", "<i4"), ("t", "<u2", (WIDE,)), ("u", "u1", (WIDE,))])  # t and u: 24 bits of each token
_SEEDS = np.random.default_rng(11).integers(1, 2**62, HASHES, dtype=np.uint64)
FOUND = "doc long, key long, v long, lo int, c int, hi int"


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """The least of every n values in a row."""
    w = 1
    while 2 * w <= n:
        h = np.minimum(h[:-w], h[w:])
        w *= 2
    return np.minimum(h[: len(h) - (n - w)], h[n - w :]) if n > w else h


def windows(h: np.ndarray, ends: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Compact windows (lo, centre, hi), as columns, of at least `least` tokens of the texts that end at `ends`.

    A centre is the leftmost least token of its window. Among centres of equal value of which each is the
    next one's left limit, every EVERY-th place is kept.
    """
    h = h >> np.uint64(1)
    sizes = np.diff(np.r_[0, ends])
    n = len(h) + len(ends) + 1
    x = np.zeros(n, np.uint64)  # with a 0, below every token, before and after each text
    place = np.arange(len(h)) + np.repeat(np.arange(1, len(ends) + 1), sizes)
    x[place] = h | np.uint64(1)
    if n < least:
        return np.zeros((0, 3), np.int64)
    # a token is a centre if it is the least of some `least` tokens in a row: the largest of their least values
    low = ~_least(x, least)
    top = ~_least(np.r_[np.full(least - 1, 2**64 - 1, np.uint64), low, np.full(least - 1, 2**64 - 1, np.uint64)], least)
    c = np.flatnonzero((x == top) & (x > 0))
    v, left, right = x[c], c.copy(), c.copy()
    table = [x]
    while (1 << len(table)) < max(2, int(sizes.max(initial=0)) + 2):
        w = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-w], table[-1][w:]))
    for k in range(len(table) - 1, -1, -1):  # as far as all tokens passed are greater (left) or not less (right)
        w, t = 1 << k, table[k]
        a = left - w
        left = np.where((a >= 0) & (t[np.clip(a, 0, len(t) - 1)] > v), a, left)
        a = right + 1
        right = np.where((a < len(t)) & (t[np.clip(a, 0, len(t) - 1)] >= v), right + w, right)
    ok = right + 1 - left >= least
    left, c, right, v = left[ok], c[ok], right[ok], v[ok]
    tie = np.r_[False, (v[1:] == v[:-1]) & (left[1:] == c[:-1] + 1)]
    run = np.maximum.accumulate(np.where(tie, 0, np.arange(len(c))))
    step = (c - c[run]) // EVERY
    keep = ~tie | (step != np.r_[0, step[:-1]])
    text = np.searchsorted(ends + np.arange(1, len(ends) + 1), c, side="left")
    return (np.stack([left, c, right + 1], axis=1) - (text + 1)[:, None])[keep]


def contents(s: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hashes of the tokens s[lo:hi]."""
    power, inverse = words._powers(len(s) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(s * power[: len(s)])]
    return words.mix((sums[hi] - sums[lo]) * inverse[lo] + words.mix((hi - lo).astype(np.uint64)))


def tokens(p: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all texts one after another, and where each text ends."""
    w = words.Words(p.column(p.schema.get_field_index("text")))
    if not len(w.h):
        return w.h, np.zeros(len(w.first) - 1, np.int64)
    n = np.maximum(np.diff(w.first) - SHINGLE + 1, 0)
    s = words.shingles(w.h, SHINGLE)
    at = np.repeat(w.first[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return (s[at] if len(at) else s[:0]), np.cumsum(n)


def hits(earlier: np.ndarray, later: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Which of the REACH tokens around each later centre the earlier one has within DRIFT places of that distance.

    limit: the shift must be less than this (a text repeats only what stands before).
    """
    mine = later[:, DRIFT:-DRIFT]
    out = np.zeros(mine.shape, bool)
    for shift in range(-DRIFT, DRIFT + 1):
        same = mine == earlier[:, DRIFT + shift : WIDE - DRIFT + shift]
        if shift >= 0:
            same &= (limit > shift)[:, None]
        out |= same
    return out & (mine > 0)


def stretches(hit: np.ndarray, least: int = LEAST, share: float = SHARE) -> np.ndarray:
    """The tokens, from the first hit to the last, of the runs of stretches of `least` tokens of which that share are hits."""
    out = np.zeros(hit.shape, bool)
    whole = hit.all(axis=1)
    out[whole] = True
    some = np.flatnonzero((hit.sum(axis=1) >= share * least) & ~whole)
    if not len(some):
        return out
    x, wide = hit[some], hit.shape[1]
    total = np.zeros((len(x), wide + 1), np.int16)
    np.cumsum(x, axis=1, out=total[:, 1:])
    ok = total[:, least:] - total[:, :-least] >= share * least
    edge = np.zeros((len(x), wide + 1), np.int8)
    edge[:, : wide + 1 - least] += ok
    edge[:, least:] -= ok
    inside = np.cumsum(edge[:, :-1], axis=1, dtype=np.int16) > 0
    # what stands in a run before its first hit or after its last is none of it
    place = np.arange(wide)
    before = np.maximum.accumulate(np.where(x, place, -1), axis=1) > np.maximum.accumulate(np.where(inside, -1, place), axis=1)
    after = np.minimum.accumulate(np.where(x, place, wide)[:, ::-1], axis=1)[:, ::-1] < np.minimum.accumulate(np.where(inside, wide, place)[:, ::-1], axis=1)[:, ::-1]
    out[some] = inside & before & after
    return out


def compare(r: np.ndarray) -> np.ndarray:
    """The found tokens around each centre, for classes sorted by value, document, key and centre."""
    start = np.searchsorted(r["v"], r["v"])
    found = np.zeros((len(r), WIDE - 2 * DRIFT), bool)
    text = r["t"].astype(np.uint32) | (r["u"].astype(np.uint32) << np.uint32(16))

    def test(i: np.ndarray, j: np.ndarray) -> None:
        for at in range(0, len(j), 4096):
            a, b = i[at : at + 4096], j[at : at + 4096]
            same = (r["doc"][a] == r["doc"][b]) & (r["key"][a] == r["key"][b])
            limit = np.where(same, r["c"][b] - r["c"][a], DRIFT + 1)
            got = stretches(hits(text[a], text[b], limit))
            cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            found[b[cut]] |= np.logical_or.reduceat(got, cut, axis=0)

    j = np.flatnonzero(start < np.arange(len(r)))
    test(start[j], j)
    # the other classes of the value that hold a token not found yet, from the earliest on
    several = np.flatnonzero(np.bincount(start, minlength=len(r))[start] > 2)
    if not len(several):
        return found
    mine = text[several, DRIFT:-DRIFT]
    row, col = np.nonzero(mine)
    name = words.mix(mine[row, col].astype(np.uint64) << np.uint64(32) | start[several][row].astype(np.uint64))
    bits = np.uint64(max(1, len(row).bit_length()))
    packed = np.sort((name >> bits << bits) | np.arange(len(row), dtype=np.uint64))
    name, entry = packed >> bits, (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row, col = several[row[entry]], col[entry]  # by token, then by row
    new = np.r_[True, name[1:] != name[:-1]]
    once = new | np.r_[True, row[1:] != row[:-1]]  # a row may have a token more than once
    holder, of = row[once], np.cumsum(once) - 1  # the rows of each token, and each place's number there
    first = np.maximum.accumulate(np.where(new[once], np.arange(len(holder)), 0))
    # a stretch that is still to be found has only tokens as hits that an earlier row has
    held = np.zeros(found.shape, bool)
    earlier = of > first[of]
    held[row[earlier], col[earlier]] = True
    held[several] = stretches(held[several])
    at = np.flatnonzero(earlier & held[row, col] & ~found[row, col])
    ptr, step = first.copy(), 1
    while len(at):
        now = np.zeros(len(holder), bool)
        now[of[at]] = True
        now = np.flatnonzero(now)
        n = np.minimum(step, now - ptr[now])
        k = np.repeat(np.arange(len(now)), n)
        i, j = holder[ptr[now][k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)], holder[now][k]
        ptr[now] += n
        pair = np.sort((j * np.int64(len(r)) + i)[i != start[j]])
        pair = pair[np.r_[True, pair[1:] != pair[:-1]]] if len(pair) else pair
        test(pair % len(r), pair // len(r))
        at = at[(ptr[of[at]] < of[at]) & ~found[row[at], col[at]]]
        step = max(1, min(2 * step, 1024, (1 << 20) // max(1, len(at))))
    return found


def _spans(found: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, ...]:
    """doc, key, first and end token of each run of found tokens."""
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, s = np.nonzero(edge == 1)
    _, e = np.nonzero(edge == -1)
    base = r["c"][row] - REACH
    return r["doc"][row], r["key"][row].astype(np.int64), base + s, base + e


def merged(doc: np.ndarray, key: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ranges of each text, joined where they meet."""
    if not len(doc):
        return doc, key, s, e
    o = np.lexsort((s, key, doc))
    doc, key, s, e = doc[o], key[o], s[o].astype(np.int64), e[o].astype(np.int64)
    text = np.cumsum(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
    end = np.maximum.accumulate(e + (text << 32))
    new = np.r_[True, s[1:] + (text[1:] << 32) > end[:-1]]
    return doc[new], key[new], s[new], (end[np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1]] - (text[new] << 32))


def _rows(doc, key, s, e, v=None, c=None) -> pa.RecordBatch:
    none = pa.nulls(len(doc), pa.int64()), pa.nulls(len(doc), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(doc)), pa.array(np.asarray(key).astype(np.int64)), none[0] if v is None else pa.array(np.ascontiguousarray(v).view(np.int64)), pa.array(np.asarray(s).astype(np.int32)), none[1] if c is None else pa.array(np.ascontiguousarray(c)), pa.array(np.asarray(e).astype(np.int32))], names=["doc", "key", "v", "lo", "c", "hi"])


def find(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Blobs of the windows; ranges of those that repeat one of the same task come in buckets below 0."""
    seen: list[dict] = [{}, {}]  # classes met more than once in this task, and their earliest window
    for p in words.parts(batches, "text", 4 << 20):
        s, ends = tokens(p)
        ids, keys = p.column(0), p.column(2).to_numpy().view(np.uint64).astype(np.uint32)
        valid = ids.is_valid().to_numpy(zero_copy_only=False)
        doc = ids.fill_null(0).to_numpy().astype(np.int64)
        sizes = np.diff(np.r_[0, ends])
        some = []
        for seed in _SEEDS:
            h = words.mix(s ^ seed)
            x = windows(h, ends)
            starts = ends - sizes
            text = np.searchsorted(ends, x[:, 1], side="right")
            x, text = x[valid[text]], text[valid[text]]
            r = np.empty(len(x), _RECORD)
            r["v"], r["k"] = words.mix(h[x[:, 1]] + seed), contents(s, x[:, 0], x[:, 2])
            r["doc"], r["key"] = doc[text], keys[text]
            for name, k in (("lo", 0), ("c", 1), ("hi", 2)):
                r[name] = x[:, k] - starts[text]
            some.append(r)
        r = np.concatenate(some) if some else np.zeros(0, _RECORD)
        if not len(r):
            continue
        r = r[np.lexsort((r["lo"], r["key"], r["doc"], r["k"], r["v"]))]
        first = np.r_[True, (r["v"][1:] != r["v"][:-1]) | (r["k"][1:] != r["k"][:-1])]
        head = np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
        keep, often = first.copy(), np.flatnonzero(np.bincount(head, minlength=len(r)) > 1)
        if len(seen[0]) > SEEN:
            seen = [{}, seen[0]]
        now, old = seen
        hot = np.isin(r["k"], np.fromiter((k[1] for k in (*now, *old)), np.uint64, len(now) + len(old))) & first
        hot[often] = True
        many = set(often.tolist())
        for i in np.flatnonzero(hot).tolist():
            k, mine = (int(r["v"][i]), int(r["k"][i])), (int(r["doc"][i]), int(r["key"][i]), int(r["lo"][i]))
            was = now.get(k) or old.get(k)
            if was is not None and was < mine:
                keep[i] = False
                now[k] = was
            elif i in many or was is not None:
                now[k] = mine
        twin = ~first & (r["doc"] == r["doc"][head]) & (r["key"] == r["key"][head]) & (r["lo"] == r["lo"][head])
        gone = r[~keep & ~twin]
        if len(gone):
            d, k, lo, hi = merged(gone["doc"], gone["key"].astype(np.int64), gone["lo"], gone["hi"])
            b = np.empty(len(d), _RECORD)
            b["doc"], b["key"], b["lo"], b["hi"], b["v"], b["k"], b["c"] = d, k, lo, hi, 0, 0, 0
            yield pa.RecordBatch.from_arrays([pa.array([-1 - int(gone["k"][0] % np.uint64(buckets))], pa.int32()), pa.array([blobs._bytes(b)], pa.binary())], names=["bucket", "records"])
        yield from blobs.pack(r[keep], r["v"][keep], buckets)


def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranges that equal windows repeat (without v), and the earliest window of each class of the values that have several."""
    done: list[pa.RecordBatch] = []

    def others() -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy() < 0
            for blob in b.column(1).filter(pa.array(own)).to_pylist():
                g = blobs._array(blob, _RECORD)
                done.append(_rows(g["doc"], g["key"], g["lo"], g["hi"]))
            yield b.filter(pa.array(~own))

    for r in blobs.unpack(others(), _RECORD):
        yield from done
        done.clear()
        o = np.argsort(r["v"])
        v = r["v"][o]
        several = np.r_[False, v[1:] == v[:-1]]
        several[:-1] |= several[1:]
        r = r[o[several]]
        if not len(r):
            continue
        r = r[np.lexsort((r["lo"], r["key"], r["doc"], r["k"], r["v"]))]
        first = np.r_[True, (r["v"][1:] != r["v"][:-1]) | (r["k"][1:] != r["k"][:-1])]
        head = np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
        twin = (r["doc"] == r["doc"][head]) & (r["key"] == r["key"][head]) & (r["lo"] == r["lo"][head])
        g = r[~first & ~twin]
        if len(g):
            yield _rows(*merged(g["doc"], g["key"].astype(np.int64), g["lo"], g["hi"]))
        r = r[first]
        several = np.r_[False, r["v"][1:] == r["v"][:-1]]
        several[:-1] |= several[1:]
        r = r[several]
        for at in range(0, len(r), 1 << 16):
            x = r[at : at + (1 << 16)]
            yield _rows(x["doc"], x["key"], x["lo"], x["hi"], x["v"], x["c"])
    yield from done


def near(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Blobs of the classes with the tokens around their centres."""
    for p in words.parts(batches, "text", 1 << 20):
        s, ends = tokens(p)
        keys, want = p.column(2).to_numpy(), p.column(3)
        row = np.repeat(np.arange(len(want)), want.value_lengths().to_numpy())
        w = want.flatten()
        v, key, c = w.field(0).to_numpy().view(np.uint64), w.field(1).to_numpy(), w.field(2).to_numpy()
        starts = ends - np.diff(np.r_[0, ends])
        ok = key == (keys[row].view(np.uint64) & np.uint64(2**32 - 1)).astype(np.int64)  # else of another text of the doc_id
        row, v, key, c = row[ok], v[ok], key[ok], c[ok]
        pad = np.zeros(len(s) + FAR * (len(ends) + 1), np.uint64)  # FAR zeros before, between and after the texts
        text = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
        pad[np.arange(len(s)) + FAR * (text + 1)] = np.maximum(words.mix(s) >> np.uint64(40), np.uint64(1))
        view = np.lib.stride_tricks.sliding_window_view(pad, WIDE) if len(pad) >= WIDE else np.zeros((0, WIDE), np.uint64)
        at = starts[row] + c + FAR * row
        doc = p.column(0).to_numpy()
        for i in range(0, len(at), 4096):
            k = slice(i, i + 4096)
            r = np.empty(len(at[k]), _NEAR)
            r["v"], r["doc"], r["key"], r["c"] = v[k], doc[row[k]], key[k], c[k]
            r["t"], r["u"] = view[at[k]] & np.uint64(0xFFFF), view[at[k]] >> np.uint64(16)
            yield from blobs.pack(r, r["v"], buckets)


def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r in blobs.unpack(batches, _NEAR):
        r = r[np.lexsort((r["c"], r["key"], r["doc"], r["v"]))]
        cut = np.flatnonzero(np.r_[True, r["v"][1:] != r["v"][:-1]])
        ends = np.r_[cut[1:], len(r)]
        i = 0
        while i < len(cut):  # whole values, about 16,384 classes at a time
            j = max(i + 1, int(np.searchsorted(ends, cut[i] + 16384, side="right")))
            part = r[cut[i] : ends[j - 1]]
            yield _rows(*merged(*_spans(compare(part), part)))
            i = j


def repeats(docs: DataFrame) -> DataFrame:
    """doc, key (of the text), and the word ranges (starts, ends) that repeat an earlier passage, for texts that have any."""
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc"), "text", F.xxhash64("text").alias("key"))
    windowed = slim.mapInArrow(lambda b: find(b, buckets), blobs.SCHEMA)
    found = scratch.write(blobs.dealt(windowed).mapInArrow(classes, FOUND), "classes")
    reps = found.where("v is not null").groupBy("doc").agg(F.collect_list(F.struct("v", "key", "c")).alias("want"))
    beside = slim.join(reps, "doc").select("doc", "text", "key", "want").mapInArrow(lambda b: near(b, buckets), blobs.SCHEMA)
    linked = scratch.write(blobs.dealt(beside).mapInArrow(link, FOUND), "linked")
    spans = found.where("v is null").union(linked)
    span = F.collect_set(F.struct(F.col("lo").alias("s"), (F.col("hi") + SHINGLE - 1).alias("e")))
    return spans.groupBy("doc", "key").agg(F.sort_array(span).alias("x")).select("doc", "key", F.col("x.s").alias("starts"), F.col("x.e").alias("ends"))


def cut(text: str, ranges: list[tuple[int, int]]) -> tuple[str, int, int, list[tuple[int, int]]]:
    """The text without those words (and the white space after each), its words, words removed, merged ranges."""
    raw = text.encode()
    low = words.LOWER[np.frombuffer(raw, np.uint8)]
    starts, _, _ = words.spans(low, np.array([0, len(low)]))
    spans: list[list[int]] = []
    for s, e in sorted(ranges):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(e, spans[-1][1])
        else:
            spans.append([s, e])
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at : starts[s]])
        at = int(starts[e]) if e < len(starts) else len(raw)
    return b"".join([*out, raw[at:]]).decode(), len(starts), sum(e - s for s, e in spans), [tuple(m) for m in spans]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The columns of docs as c0, c1, ..., the text without repeated passages; n_words, removed (words) and spans."""
    i, n = docs.columns.index("text"), len(docs.columns)
    plain = docs.toDF(*[f"c{k}" for k in range(n)])
    doc, key = F.col(f"c{docs.columns.index('doc_id')}").cast("long"), F.expr(f"xxhash64(c{i}) & {2**32 - 1}L")
    found = repeats(docs)
    both = plain.join(found, (doc == F.col("doc")) & (key == F.col("key")), "left").drop("doc", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.parts(batches, f"c{i}", 4 << 20):
            text = b.column(i)
            w = words.Words(text)
            total = np.diff(w.first)
            at = np.flatnonzero(b.column(n).is_valid().to_numpy(zero_copy_only=False))
            removed, spans, mask, now = np.zeros(b.num_rows, np.int64), [[]] * b.num_rows, np.zeros(b.num_rows, bool), []
            for k, t, s, e in zip(at.tolist(), *(b.column(x).take(pa.array(at)).to_pylist() for x in (i, n, n + 1))):
                t, _, removed[k], m = cut(t, list(zip(s, e)))
                spans[k], mask[k] = [list(x) for x in m], True
                now.append(t)
            columns = list(b.columns)[:n]
            if now:
                columns[i] = pa.compute.replace_with_mask(text, pa.array(mask), pa.array(now, text.type))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total.astype(np.int64)), pa.array(removed), pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=[*b.schema.names[:n], "n_words", "removed", "spans"])

    schema = plain.selectExpr("*", "0L as n_words", "0L as removed", "array(array(0L)) as spans").schema
    return both.mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs.select("doc_id", "text")).select(F.col("c0").alias("doc_id"), "n_words", F.col("removed").alias("n_removed"), "spans", F.sha2("c1", 256).alias("text_sha256"))


def stage(docs: DataFrame) -> DataFrame:
    """The documents without repeated passages; one that loses all its words goes."""
    return remove_repeats(docs).where("removed < n_words or n_words = 0").drop("n_words", "removed", "spans").toDF(*docs.columns)
