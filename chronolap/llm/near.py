"""Operator 3, near-duplicates by an LSH forest of MinHash signatures, links confirmed on full sets.

A document's set holds its distinct shingles of `words` words (lower-cased A-Z; fewer words: the whole
sequence as one; null, empty or blank text: no set, linked with nothing). Equal sets are one class, named by
a 64-bit hash of the set, from the start. Each of ORDERS orders of the signature sorts the classes by DEPTH
values; those that share at least the first SHALLOW stand together, and each is a candidate with the one
before it, its neighbour by longest common prefix. A region starts at SHALLOW values and is taken one value
deeper as long as more than DENSE classes share them; each class is also a candidate with the least of its
region. Each class is first confirmed on full sets beside the candidate that most of its orders name, in
chunks of about BLOCK; a cluster that this leaves in several parts is compared again, all of it with those
outside its largest part, in blocks of about BLOCK by BLOCK. Confirmed links give the components.
Rows with the same doc_id and different texts are one document and linked; a row without a doc_id has the
component of what it is linked with, or null. Extra columns are not read. A pair at a similarity of 0.85
shares no prefix of SHALLOW values in any order with a chance of 2e-8, one at 0.8 with 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolap.llm import blobs, scratch, words

ORDERS, SHALLOW, DEPTH, DENSE, BLOCK, SEEN = 24, 4, 8, 64, 512, 1 << 18
NO_ID = 2**63 - 1
SMALL = 1 << 21  # edges that one task may end, 32 MB of them
HEAVY = 1 << 21  # shingles of a block beyond which it is split, however few its documents
_MULT = np.random.default_rng(7).integers(1, 2**62, ORDERS * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = "doc_id long, id long, key long, n_shingles long, node long, signature binary"
_PLACE = np.dtype([("head", "<u8"), ("rest", "<u4", (DEPTH - SHALLOW,)), ("node", "<i8")])


def sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    w = words.Words(column)
    for i in range(len(w.first) - 1):
        yield np.unique(words.shingles(w.h[w.first[i] : w.first[i + 1]], k))


def name(s: np.ndarray) -> int:
    """64-bit hash of a set."""
    m = words.mix(s)
    return int(words.mix(np.array([s.sum() ^ words.mix(np.array([np.bitwise_xor.reduce(m) + np.uint64(len(s))]))[0]], dtype=np.uint64))[0].view(np.int64))


def signature(s: np.ndarray, count: int = ORDERS * DEPTH) -> np.ndarray:
    low = np.full(count, 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(s), 2048):  # bounded for very long texts
        np.minimum(low, ((s[None, i : i + 2048] * _MULT[:count, None]) >> np.uint64(32)).min(axis=1).astype(np.uint32), out=low)
    return low


def _base(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in words.parts(batches, "text", 2 << 20):
            out = [(len(s), name(s), signature(s).tobytes()) if len(s) else (0, None, None) for s in sets(p.column(1), k)]
            n, node, sig = zip(*out)
            yield pa.RecordBatch.from_arrays([p.column(0), p.column(0).fill_null(NO_ID), p.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "id", "key", "n_shingles", "node", "signature"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("key")).mapInArrow(run, _BASE)


def orders(base: DataFrame, buckets: int) -> DataFrame:
    """Blobs of the classes' places in each order; a task sends a class once, as far as its table goes."""
    tree = np.arange(ORDERS, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            node = b.column(0).to_pylist()
            new = [i for i, x in enumerate(node) if x not in seen and not seen.add(x)]
            if len(seen) > SEEN:
                seen = set()
            if not new:
                continue
            v = np.frombuffer(b"".join(b.column(1).take(pa.array(new)).to_pylist()), np.uint32).reshape(len(new), ORDERS, DEPTH)
            h = np.broadcast_to(words.mix(tree + np.uint64(1024)), (len(new), ORDERS))
            for i in range(SHALLOW):
                h = words.mix(h ^ v[:, :, i].astype(np.uint64))
            r = np.empty(h.size, _PLACE)
            r["head"], r["rest"], r["node"] = h.ravel(), v[:, :, SHALLOW:].reshape(-1, DEPTH - SHALLOW), np.repeat(np.array(node, dtype=object)[new].astype(np.int64), ORDERS)
            yield from blobs.pack(r, r["head"], buckets)

    return base.where("n_shingles > 0").select("node", "signature").mapInArrow(run, blobs.SCHEMA)


def candidates(r: np.ndarray, dense: int = DENSE) -> np.ndarray:
    """(node, other) of sorted places: the neighbour before each, and the least node of its region."""
    r = r[np.lexsort((r["node"], *(r["rest"][:, i] for i in range(DEPTH - SHALLOW - 1, -1, -1)), r["head"]))]
    same = r["head"][1:] == r["head"][:-1]
    r = r[np.r_[True, ~same | (r["node"][1:] != r["node"][:-1])]]
    if len(r) < 2:
        return np.zeros((0, 2), np.int64)
    common = np.where(r["head"][1:] == r["head"][:-1], SHALLOW + np.cumprod(r["rest"][1:] == r["rest"][:-1], axis=1).sum(axis=1), 0)
    common = np.r_[0, common]  # values shared with the one before
    least, open_ = np.zeros(len(r), np.int64), np.ones(len(r), bool)
    for depth in range(SHALLOW, DEPTH + 1):
        at = np.flatnonzero(common < depth)
        region = np.cumsum(common < depth) - 1
        settled = open_ & ((np.diff(np.r_[at, len(r)])[region] <= dense) | (depth == DEPTH))
        least[settled] = np.minimum.reduceat(r["node"], at)[region][settled]
        open_ &= ~settled
    near = np.flatnonzero(common >= SHALLOW)
    pairs = np.r_[np.stack([r["node"][near], r["node"][near - 1]], 1), np.stack([r["node"], least], 1)]
    return pairs[pairs[:, 0] != pairs[:, 1]]


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, other, votes) from the places of each bucket."""
    for r in blobs.unpack(batches, _PLACE):
        pairs, votes = np.unique(candidates(r), axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(votes.astype(np.int64))], names=["node", "head", "votes"])


def lowest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and the smallest node that each can reach."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
    return ids, ids[root]


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); the component is its smallest node.

    Large-star and small-star rounds on written tables until nothing changes or at most `small` edges are
    left, by count; one task ends those. No links reach the driver.
    """

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if got:
            ids, low = lowest(*(np.concatenate(x) for x in zip(*got)))
            for i in range(0, len(ids), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + (1 << 16)]), pa.array(low[i : i + (1 << 16)])], names=["node", "component"])

    def few(now: DataFrame) -> DataFrame:
        return scratch.write(now.repartition(1).mapInArrow(finish, "node long, component long"), "components")

    now, last = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"), None
    if now.count() <= small:
        return few(now)
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = scratch.write(large.where("u <> v").distinct(), "large")
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        tiny = big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        new = scratch.write(tiny.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.col("u") % 1000003)).first()
        scratch.drop(now, big)
        now = new
        if state == last:
            break
        if state[0] <= small:
            return few(now)
        last = state
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v"), F.col("v")).distinct())


def parity(s: np.ndarray) -> np.ndarray:
    """1024 bits of which each shingle flips one, so two sets differ in at least as many shingles as bits."""
    return np.packbits((np.bincount((words.mix(s + np.uint64(5)) >> np.uint64(54)).astype(np.int64), minlength=1024) & 1).astype(np.uint8)).view(np.uint64)


def linked(found: list[np.ndarray], percent: int, part: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of {i, j: 100 * |i & j| >= percent * |i | j|}, each confirmed on the full sets.

    Those of the same part are linked already. Pairs are left out by size and by parity bits only, which
    cannot drop a link.
    """
    root = list(range(len(found)))
    if part is not None:
        lead: dict[int, int] = {}
        root = [lead.setdefault(int(c), i) for i, c in enumerate(part)]

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    n = np.array([len(s) for s in found])
    order = np.argsort(n, kind="stable")
    out: list[tuple[int, int]] = []
    values, inverse = np.unique(np.concatenate(found), return_inverse=True)
    cut = np.split(inverse, np.cumsum(n)[:-1])
    seen = np.zeros(len(values), dtype=bool)
    bits = np.array([parity(s) for s in found])
    for at, i in enumerate(order):
        rest = order[at + 1 :]
        rest = rest[100 * n[i] >= percent * n[rest]]
        both = n[i] + n[rest]
        rest = rest[np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64) <= both - 2 * (-(-percent * both // (100 + percent)))]
        if not len(rest):
            continue
        seen[cut[i]] = True
        for j in rest:
            if top(i) != top(j):
                both = int(seen[cut[j]].sum())
                if 100 * both >= percent * (n[i] + n[j] - both):
                    root[top(j)] = top(i)
                    out.append((int(i), int(j)))
        seen[cut[i]] = False
    return out


def near_duplicates(docs: DataFrame, words_each: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept, one row for each document."""
    spark = docs.sparkSession
    base = scratch.write(_base(docs, words_each), "signatures")
    whole = base.where("n_shingles > 0")
    classes = whole.groupBy("node").agg(F.min(F.struct("id", "key")).alias("rep"), F.max("n_shingles").alias("w"))
    places = blobs.dealt(orders(base, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = places.mapInArrow(neighbours, "node long, head long, votes long")
    near = scratch.write(found.groupBy("node", "head").agg(F.sum("votes").alias("votes")), "neighbours")
    clusters = scratch.write(components(near.select(F.col("node").alias("a"), F.col("head").alias("b"))), "clusters")
    nodes = scratch.write(clusters.join(classes, "node").select("node", "component", "w", "rep"), "nodes")
    weight = nodes.select("node", "w")
    ids = nodes.select("node", "rep.id", "rep.key")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("key"), "text")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("w") / HEAVY))

    def confirm(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")  # a row repeated as it is
        ids = pdf["node"].to_numpy()
        found = [s for i in range(0, len(pdf), 64) for s in sets(pa.array(pdf["text"].iloc[i : i + 64], pa.string()), words_each)]
        e = linked(found, percent, pdf["part"].to_numpy()) if len(ids) > 1 else []
        return pd.DataFrame({"a": [ids[i] for i, _ in e], "b": [ids[j] for _, j in e]}, dtype="int64")

    def confirmed(placed: DataFrame, *key: str) -> DataFrame:
        there = placed.select(*(F.col(k).alias(f"at_{k}") for k in key), "node", "part").join(ids, "node")
        sent = texts.join(there.hint("merge"), ["id", "key"]).select(*(F.col(f"at_{k}").alias(k) for k in key), "node", "part", "text")
        return sent.groupBy(*key).applyInPandas(confirm, "a long, b long")

    best = near.groupBy("node").agg(F.max_by("head", F.struct("votes", -F.col("head"))).alias("head")).join(weight, "node")
    chunk = F.expr("pmod(xxhash64(node), blocks)")
    star = scratch.write(best.join(best.groupBy("head").agg(blocks.alias("blocks")), "head").select("head", chunk.alias("k"), "node"), "stars")
    star = star.union(star.select("head", "k", F.col("head").alias("node")).distinct()).withColumn("part", F.col("node"))
    first = scratch.write(confirmed(star, "head", "k"), "stars_linked")

    parts = nodes.drop("rep").join(components(first).withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    parts = scratch.write(parts, "parts")
    sizes = parts.groupBy("component", "part").agg(F.count("*").alias("n")).groupBy("component").agg(F.max_by("part", F.struct("n", -F.col("part"))).alias("largest"), F.count("*").alias("m"))
    open_ = scratch.write(parts.join(sizes.where("m > 1").drop("m"), "component").withColumn("other", F.col("part") != F.col("largest")), "open")
    dims = open_.groupBy("component").agg(blocks.alias("blocks")).join(open_.where("other").groupBy("component").agg(blocks.alias("sides")), "component")
    dealt = open_.join(dims, "component").withColumn("k", chunk).withColumn("c", F.expr("pmod(xxhash64(node), sides)"))
    everyone = dealt.withColumn("c", F.explode(F.expr("sequence(0L, sides - 1)")))
    others = dealt.where("other and blocks > 1").withColumn("k", F.explode(F.expr("sequence(0L, blocks - 1)")))
    placed = everyone.union(others).select("component", "c", "k", "node", "part").distinct()
    # the texts of one doc_id are one document
    shared = whole.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("c")).where("b <> c").drop("c")
    links = scratch.write(first.union(confirmed(placed, "component", "c", "k")).union(whole.join(shared, "doc_id").select(F.col("node").alias("a"), "b")), "links")
    comp = scratch.write(components(links), "components")
    scratch.drop(near, clusters, star, first, parts, open_)
    least = classes.select("node", "rep.id").join(comp, "node").groupBy("component").agg(F.min("id").alias("least"))
    final = classes.select("node", "rep.id").join(comp.join(least, "component").select("node", "least"), "node", "left").select("node", F.coalesce("least", "id").alias("c"))
    out = base.select("doc_id", "n_shingles", "node").join(final, "node", "left").select("doc_id", "n_shingles", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.nullif("c", F.lit(NO_ID))).alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def stage(docs: DataFrame) -> DataFrame:
    """The documents that stand first in their group, with their columns; those without a doc_id stay, compared with none."""
    named = docs.where("doc_id is not null")
    kept = near_duplicates(named).where("kept").select("doc_id").distinct()
    return named.join(kept, "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))
