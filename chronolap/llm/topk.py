"""Operator 8, exact top-k by inner product with block-at-a-time pruning.

Components become floor(256 * x). Rows are dealt by hash into blocks of about BLOCK vectors, each with
the largest and smallest value of every dimension. For a query these maxima sum to a bound of any score
in the block; blocks are visited by falling bound and scored through their forward index (a matrix)
until the bound is below the k-th score so far; equal bounds are still visited, as ties go to the
smaller id. Query blocks meet groups of document blocks; the best k of each group are merged. Vectors
that are null, or hold a null or non-finite component, take no part; shorter ones count as padded
with 0. Rows with the same id are separate rows and queries; a query leaves out itself, not its twins.
On vectors without any order no bound is below the k-th score and all blocks are scored. Scores are exact in
float64 below 2**53 and are computed with whole numbers beyond.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, GROUP, QUERIES = 512, 4096, 1024


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    m = np.zeros((len(column), width))
    for i, v in enumerate(column):
        m[i, : len(v)] = v
    return m


def search(q_ids: np.ndarray, q: np.ndarray, d_ids: np.ndarray, d: np.ndarray, k: int, scored: list[int] | None = None) -> tuple[list, list, list]:
    """The best k of d for every query, by its place; ties to the smaller id. scored: gets the blocks scored for each."""
    exact = np.abs(q).max(initial=0) * np.abs(d).max(initial=0) * max(1, q.shape[1]) < 2**53
    order = np.argsort(np.abs(d).argmax(axis=1) * 2 + (d.sum(axis=1) > 0), kind="stable") if len(d) else np.zeros(0, int)
    cut = [order[i : i + BLOCK] for i in range(0, len(order), BLOCK)]
    high = np.array([d[c].max(axis=0) for c in cut])
    low = np.array([d[c].min(axis=0) for c in cut])
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    out: tuple[list, list, list] = ([], [], [])
    for i in range(len(q)):
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.float64 if exact else object)
        itself = np.flatnonzero((d_ids == q_ids[i]) & (d == q[i]).all(axis=1))[:1]
        visited = 0
        for b in np.argsort(-bounds[i], kind="stable"):
            if exact and len(ids) == k and bounds[i, b] < scores[-1]:
                break
            visited += 1
            own = ~np.isin(cut[b], itself)
            s = d[cut[b]] @ q[i] if exact else np.array([sum(int(x) * int(y) for x, y in zip(r, q[i])) for r in d[cut[b]]], dtype=object)
            ids, scores = np.r_[ids, d_ids[cut[b]][own]], np.r_[scores, s[own]]
            best = np.lexsort((ids, -scores))[:k] if exact else np.array(sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:k], dtype=int)
            ids, scores = ids[best], scores[best]
        if scored is not None:
            scored.append(visited)
        out[0].extend([i] * len(ids))
        out[1].extend(ids)
        out[2].extend(int(s) for s in scores)
    return out


def topk(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by `every`, against all others."""
    good = vectors.where("vec_id is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    v = good.select("vec_id", F.expr("transform(embedding, x -> floor(256 * double(x)))").cast("array<double>").alias("v"))
    n, nq = v.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    groups, heaps = max(1, -(-n // GROUP)), max(1, -(-nq // QUERIES))
    d = v.withColumn("g", F.expr(f"pmod(xxhash64(vec_id, v, 1), {groups}L)")).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(heaps - 1))))
    same = v.where(F.col("vec_id") % every == 0).groupBy("vec_id", "v").agg(F.count("*").alias("n"))  # equal rows ask once
    q = same.withColumn("h", F.expr(f"int(pmod(xxhash64(vec_id, v, 2), {heaps}L))")).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).withColumn("key", F.xxhash64("v"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "key": [], "n": [], "vec_id": [], "score": []}, dtype="int64")
        width = max(max(map(len, left["v"])), max(map(len, right["v"])))
        at, ids, scores = search(left["vec_id"].to_numpy(), _matrix(left["v"], width), right["vec_id"].to_numpy(), _matrix(right["v"], width), k)
        return pd.DataFrame({"query_id": left["vec_id"].to_numpy()[at], "key": left["key"].to_numpy()[at], "n": left["n"].to_numpy()[at], "vec_id": ids, "score": scores}, dtype="int64")

    some = q.groupBy("g", "h").cogroup(d.groupBy("g", "h")).applyInPandas(run, "query_id long, key long, n long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    best = some.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.withColumn("copy", F.explode(F.expr("sequence(1L, n)"))).select("query_id", "rank", "vec_id", "score")


query = topk

SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, x -> floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.place, d.vec_id, list_dot_product(q.v::DOUBLE[], d.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v d ON q.place <> d.place WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
