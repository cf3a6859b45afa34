"""Operator 1, LM scoring: a log-bilinear model trained by noise-contrastive estimation.

Words (lower-cased A-Z) and one end token for each text. Counts of all training words are summed over
the cluster. The HEAD most frequent words are known to every task (a fixed bound); the CLASSES most
frequent of them are classes of their own, all others share TAILS classes by their last two bytes and
whether they are in the head. The model scores a class from the class before it by r(before) . q(next)
+ b(next); it is trained in numpy against noise from the class frequencies, on the class pairs of the
whole training corpus, and normalised by one matrix product. A word of a shared class has the share
(c + 1) / (its class's counts + its class's distinct words + 1), an unknown one 1 over the same, so the
whole is a distribution. Words outside the head are joined with their counts. Null counts as empty;
an empty text is its end token. Repeated rows are scored each; doc_id is only a row's name.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolap.llm import scratch, words
from chronolap.llm.lines import token_counts

HEAD, CLASSES, TAILS, WIDTH, NOISE, STEPS = 65536, 512, 256, 24, 10, 150
END = np.uint64(0x5EED5EED5EED5EED)
HELD = "pmod(crc32(cast(doc_id as string)), 7) = 2"


class Vocabulary:
    """Sorted hashes of the head with counts; class 0 ends a text, then CLASSES words, then the shared ones."""

    def __init__(self, head: list[tuple[int, int]]):
        h = np.array([x[0] for x in head], dtype=np.int64).view(np.uint64)
        n = np.array([x[1] for x in head], dtype=np.int64)
        self.own = min(CLASSES, len(h))
        o = np.argsort(h, kind="stable")
        self.h, self.n, rank = h[o], n[o], o
        self.single = np.where(rank < self.own, rank + 1, 0)
        self.size = 1 + self.own + TAILS

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the head, and whether it is there."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        p = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return p, self.h[p] == h

    def classes(self, w: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, there = self.look(w.h)
        last = w.low[w.ends - 1].astype(np.uint32)
        prev = np.where(w.ends - w.starts > 1, w.low[np.maximum(w.ends - 2, 0)], 0).astype(np.uint32)
        tail = ((prev * np.uint32(257) + last) * np.uint32(2654435761) >> np.uint32(25)).astype(np.int64) + np.where(there, 0, TAILS // 2)
        own = there & (self.single[p] > 0) if len(self.h) else there
        return p, there, np.where(own, self.single[p] if len(self.h) else 0, 1 + self.own + tail)


def sequences(w: words.Words, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class before, class, row) of every token with ends; the text's start looks like an end."""
    rows = len(w.first) - 1
    row = np.repeat(np.arange(rows), np.diff(w.first))
    at = np.arange(len(c)) + row
    now = np.zeros(len(c) + rows, np.int64)
    now[at] = c
    whose = np.zeros(len(now), np.int64)
    whose[at] = row
    whose[w.first[1:] + np.arange(rows)] = np.arange(rows)
    return np.r_[0, now[:-1]] if len(now) else now, now, whose


def fit(pairs: np.ndarray, steps: int = STEPS, seed: int = 5) -> np.ndarray:
    """log10 P(class | class before) from a matrix of pair counts, by noise-contrastive estimation.

    Noise has NOISE times as many tokens as the data, dealt by class frequency; its expectation is
    taken exactly, so training is repeatable. Adam over all pairs; then each row is normalised.
    """
    k = len(pairs)
    freq = (pairs.sum(axis=0) + 0.5).astype(np.float64)
    q = (freq / freq.sum()).astype(np.float32)
    context = pairs.sum(axis=1, keepdims=True).astype(np.float32)
    weight = 1 / max(1.0, float(pairs.sum()))
    data, noise = (pairs * weight).astype(np.float32), NOISE * context * weight * q[None, :]
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 0.1, (k, WIDTH)).astype(np.float32), rng.normal(0, 0.1, (k, WIDTH)).astype(np.float32), np.log(q)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    shift = np.log(NOISE * q)[None, :]
    for t in range(1, steps + 1):
        s = p[0] @ p[1].T + p[2] - shift
        real = 1 / (1 + np.exp(-s))
        g = noise * real - data * (1 - real)
        grads = [g @ p[1], g.T @ p[0], g.sum(axis=0)]
        for x, d, a, b in zip(p, grads, m, v):
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            x -= 0.05 * (1 - t / (steps + 1)) * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-10)
    s = (p[0] @ p[1].T + p[2]).astype(np.float64)
    s -= s.max(axis=1, keepdims=True)
    return (s - np.log(np.exp(s).sum(axis=1, keepdims=True))) / np.log(10)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    learn = docs.where(f"doc_id is null or not ({HELD})")
    counts = scratch.write(token_counts(learn), "counts")
    n_docs = learn.count()
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = total + n_docs, distinct + bool(n_docs)
    vocab = Vocabulary([tuple(r) for r in counts.orderBy(F.desc("n"), "h").limit(HEAD).collect()])  # a fixed bound

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = vocab.size
        cells, inside = np.zeros(size * size, np.int64), np.zeros((size, 2), np.int64)
        for p in words.parts(batches, "text"):
            w = words.Words(p.column(0))
            a, b, _ = sequences(w, vocab.classes(w)[2])
            cells += np.bincount(a * size + b, minlength=size * size)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], names=["cell", "n"])

    cells = learn.select("text").mapInArrow(pairs, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most size * size rows
    size = vocab.size
    matrix = np.zeros(size * size, np.int64)
    matrix[cells["cell"].to_numpy(dtype=np.int64)] = cells["n"].to_numpy(dtype=np.int64)
    matrix = matrix.reshape(size, size)
    logp = fit(matrix).astype(np.float32)

    # Distinct words of each shared class: head ones by suffix inside the head; the rest from the counts table by suffix.
    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in words.parts(batches, "text"):
            w = words.Words(p.column(0))
            h, i = np.unique(w.h, return_index=True)
            c = vocab.classes(w)[2][i]
            yield pa.RecordBatch.from_arrays([pa.array(h[c > vocab.own].view(np.int64)), pa.array(c[c > vocab.own])], names=["h", "c"])

    kinds = {r[0]: r[1] for r in learn.select("text").mapInArrow(suffixes, "h long, c long").distinct().groupBy("c").count().collect()}  # at most TAILS rows
    inside = matrix.sum(axis=0)
    share = np.zeros(size)
    for c in range(vocab.own + 1, size):
        share[c] = log10(int(inside[c]) + kinds.get(c, 0) + 1)
    base = log10(total + distinct + 1)
    ends = log10(n_docs + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_n = np.log10(vocab.n + 1.0) if len(vocab.n) else np.zeros(1)
        for p in words.parts(batches, "text", 4 << 20):
            w = words.Words(p.column(1))
            place, there, c = vocab.classes(w)
            rows = len(w.first) - 1
            a, b, whose = sequences(w, c)
            row = np.repeat(np.arange(rows), np.diff(w.first))
            known = np.where(there, log_n[place], 0.0)
            tokens = np.diff(w.first) + 1
            lb = np.bincount(row, known, rows) + ends - tokens * base
            sc = np.bincount(whose, logp[a, b], rows) + np.bincount(row, np.where(c > vocab.own, known - share[c], 0.0), rows)
            rare = np.flatnonzero(~there)
            cut = np.searchsorted(rare, w.first)
            v = w.h[rare].view(np.int64)
            yield pa.RecordBatch.from_arrays([p.column(0), pa.array(tokens.astype(np.int64)), pa.array(np.bincount(row, there, rows).astype(np.int64) + (n_docs > 0)), pa.array(lb), pa.array(sc), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(v))], names=["doc_id", "n_tokens", "n_known", "base_score", "score", "rare"])

    rows = scratch.write(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<long>").withColumn("_row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("_row", F.explode("rare").alias("h")).join(counts, "h")
    more = rare.groupBy("_row").agg(F.count("*").alias("k"), F.sum(F.log10(F.col("n") + F.lit(1.0))).alias("l"))
    out = rows.drop("rare").join(more, "_row", "left").withColumns({"k": F.coalesce("k", F.lit(0)), "l": F.coalesce("l", F.lit(0.0))})
    return out.select("doc_id", F.coalesce(F.expr(HELD), F.lit(False)).alias("held_out"), "n_tokens", (F.col("n_known") + F.col("k")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base_score") + F.col("l")).alias("base_score"), (F.col("score") + F.col("l")).alias("score"))


query = score
