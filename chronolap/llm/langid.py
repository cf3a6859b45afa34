"""Operator 4, language ID: the family first, then one-versus-one linear SVMs inside it.

Learns from at most SAMPLE distinct labelled texts of each language (a documented bound; those with the
smallest hash of the text, however large the table is). Families are languages whose mean profiles are alike. Features are hashed byte
pairs and triples of whole lower-cased texts (the bytes themselves of texts of up to two). The score is the
certainty of the family times that of the closest comparison inside it. A text that is null or has no letter is `und` with score 0; without
any labelled text every row is `und`. Ties go to the first language by name. Only text is an input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolap.llm import words

SAMPLE, WIDTH = 300, 4096
_LETTER = re.compile(r"[^\W\d_]")


def features(column: pa.Array) -> np.ndarray:
    """A row of square-rooted shares of hashed byte pairs and triples for each text."""
    raw, off = words.buffers(column)
    low = words.LOWER[raw].astype(np.uint32)
    out = np.zeros((len(off) - 1, WIDTH), np.float32)
    for i in range(len(off) - 1):
        total = np.zeros(WIDTH, np.int64)
        for at in range(off[i], off[i + 1], 1 << 20):  # blocks overlap by two bytes, so n-grams are whole
            b = low[at : min(at + (1 << 20) + 2, off[i + 1])]
            two = b[: (1 << 20) + 1]
            g = [two[:-1] * 257 + two[1:], (b[:-2] * 66049 + b[1:-1] * 257 + b[2:])] if len(b) > 2 else [b]
            for x in g:
                total += np.bincount(((x * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64), minlength=WIDTH)
        if s := total.sum():
            out[i] = np.sqrt(total / s)
    return out


def svm(x: np.ndarray, y: np.ndarray, passes: int = 30, c: float = 10.0) -> np.ndarray:
    """Linear SVM (last weight is the bias) by dual coordinate descent; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    w, a, q = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(axis=1)
    rng = np.random.default_rng(3)
    for _ in range(passes):
        for i in rng.permutation(len(x)):
            new = min(max(a[i] - (y[i] * (x[i] @ w) - 1) / q[i], 0), c)
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w


def train(x: np.ndarray, langs: list[str]) -> dict:
    names = sorted(set(langs))
    lang = np.array(langs)
    mean = {k: x[lang == k].mean(axis=0) for k in names}
    family: dict[str, int] = {}
    sims = [float(mean[a] @ mean[b]) for i, a in enumerate(names) for b in names[i + 1 :]]
    limit = np.median(sims) if len(sims) > 1 else 2.0
    for k in names:  # joins the family of its nearest language before it, if that is nearer than the median pair
        near = max(family, key=lambda o: float(mean[o] @ mean[k]), default=None)
        family[k] = family[near] if near is not None and mean[near] @ mean[k] > limit else len(set(family.values()))
    fam = np.array([family[k] for k in langs])
    return {"names": names, "family": family, "heads": {f: svm(x, np.where(fam == f, 1.0, -1.0)) for f in sorted(set(fam))}, "pairs": {(a, b): svm(x[(lang == a) | (lang == b)], np.where(lang[(lang == a) | (lang == b)] == a, 1.0, -1.0)) for i, a in enumerate(names) for b in names[i + 1 :] if family[a] == family[b]}}


def predict(model: dict, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    margin = lambda w: x @ w[:-1] + w[-1]
    heads = list(model["heads"])
    m = np.array([margin(model["heads"][f]) for f in heads])
    pick = m.argmax(axis=0)
    votes = {k: np.where(np.array([heads[p] for p in pick]) == model["family"][k], 0.0, -np.inf) for k in model["names"]}
    sure = 1 / (1 + np.exp(-np.clip(2 * m.max(axis=0), -30, 30)))
    close = {k: np.full(len(x), np.inf) for k in model["names"]}
    for (a, b), w in model["pairs"].items():
        d = margin(w)
        close[a], close[b] = np.minimum(close[a], d), np.minimum(close[b], -d)
        votes[a] = votes[a] + np.tanh(d) + np.sign(d)
        votes[b] = votes[b] - np.tanh(d) - np.sign(d)
    v = np.array([votes[k] for k in model["names"]])
    best = v.argmax(axis=0)
    near = np.array([close[k] for k in model["names"]])[best, np.arange(len(x))]
    return [model["names"][i] for i in best], sure / (1 + np.exp(-np.clip(2 * near, -30, 30)))


def sample(docs: DataFrame, per: int) -> list:
    """At most `per` labelled rows of each language, of distinct texts, those with the smallest hash of the text."""
    t = docs.where("text is not null and lang is not null and crc32(cast(doc_id as string)) % 4 <> 2").select("lang", F.xxhash64("text").alias("h"), "doc_id", "text")

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # of each language at most `per` hashes, with the smallest doc_id of each
        for b in batches:
            now = pa.Table.from_batches([b])
            now = (now if kept is None else pa.concat_tables([kept, now])).group_by(["lang", "h"]).aggregate([("doc_id", "min")])
            lang, h = now.column("lang").combine_chunks().dictionary_encode().indices.to_numpy(), now.column("h").to_numpy()
            by = np.lexsort((h, lang))
            n = np.bincount(lang)
            rank = np.arange(len(by)) - np.repeat(np.cumsum(n) - n, n)
            kept = now.take(pa.array(by[rank < per])).rename_columns({"doc_id_min": "doc_id"}).select(["lang", "h", "doc_id"])
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    few = t.select("lang", "h", "doc_id").mapInArrow(smallest, "lang string, h long, doc_id long")
    pick = few.groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id")).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= per)
    got = t.join(F.broadcast(pick.drop("r")), ["lang", "h", "doc_id"]).select("text", "lang").collect()  # at most `per` for each language
    return list({(r[0], r[1]) for r in got})


def identify(docs: DataFrame, per: int = SAMPLE) -> DataFrame:
    """Every row and column, with lang_pred and score (which replace columns of those names)."""
    docs = docs.drop("lang_pred", "score")
    return lettered(docs, per).drop("letter").toDF(*docs.columns, "lang_pred", "score")


def lettered(docs: DataFrame, per: int) -> DataFrame:
    """The columns of docs as c0, c1, ..., then lang_pred, score and whether the text has a letter."""
    got = sorted((r[0], r[1]) for r in sample(docs, per))
    model = train(features(pa.array([g[0] for g in got], pa.string())), [g[1] for g in got]) if got else None
    if model:
        model["heads"] = {k: w.astype(np.float32) for k, w in model["heads"].items()}
        model["pairs"] = {k: w.astype(np.float32) for k, w in model["pairs"].items()}
    at = docs.columns.index("text")
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.parts(batches, f"c{at}", 2 << 20):
            column = b.column(at)
            texts = column.to_pylist()
            letter = np.array([bool(t and _LETTER.search(t)) for t in texts])
            names, score = predict(model, features(column)) if model else (["und"] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([k if ok else "und" for k, ok in zip(names, letter)]), pa.array(np.where(letter, score, 0.0).astype(np.float64)), pa.array(letter)], names=[*b.schema.names, "lang_pred", "score", "letter"])

    return plain.mapInArrow(run, plain.selectExpr("*", "'' as lang_pred", "0.0D as score", "true as letter").schema)


def query(docs: DataFrame) -> DataFrame:
    return identify(docs.select("doc_id", "text", "lang")).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def stage(docs: DataFrame) -> DataFrame:
    """The documents with a language; null texts and those without a letter go, and nothing else if no language could be learned."""
    return lettered(docs, SAMPLE).where("letter").drop("lang_pred", "score", "letter").toDF(*docs.columns)
