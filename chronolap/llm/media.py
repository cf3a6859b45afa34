"""Operator 9, media columns: texts stored as WAV, read back, and fingerprinted by spectral peaks.

Null counts as empty text. The payload is the UTF-8 bytes and bytes 255 up to a positive multiple of
BLOCK; it is written as 8-bit mono samples by the wave module and read back from the stored bytes. A
short-time Fourier transform takes frames of BLOCK samples; in each frame the strongest bins are peaks,
and each peak is paired with peaks of the next frames. A pair is one long: anchor frame << 32 |
anchor bin << 20 | partner bin << 8 | frame distance. Rows are independent; extra columns are dropped.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolap.llm import words

BLOCK, RATE, PEAKS, AHEAD = 576, 8000, 3, 3
SCHEMA = "doc_id long, n_bytes long, media binary, payload binary, fingerprint array<long>"
_HANN = np.hanning(BLOCK).astype(np.float32)


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))


def store(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def fingerprint(samples: bytes) -> np.ndarray:
    x = np.frombuffer(samples, dtype=np.uint8).reshape(-1, BLOCK).astype(np.float32) - 128
    found = []
    for at in range(0, len(x), 4096):  # bounded for very long texts
        power = np.abs(np.fft.rfft(x[at : at + 4096] * _HANN, axis=1))[:, 1:]
        found.append(np.sort(np.argsort(-power, axis=1, kind="stable")[:, :PEAKS], axis=1) + 1)
    peaks = np.concatenate(found).astype(np.int64)
    pairs = []
    for d in range(1, AHEAD + 1):
        if len(peaks) > d:
            t = np.arange(len(peaks) - d, dtype=np.int64)[:, None, None]
            pairs.append(((t << 32) | (peaks[:-d, :, None] << 20) | (peaks[d:, None, :] << 8) | d).ravel())
    return np.sort(np.concatenate(pairs)) if pairs else peaks.ravel()


def media_columns(docs: DataFrame) -> DataFrame:
    """One row for each document with its stored form, the payload read back, and the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.parts(batches, "text", 4 << 20):
            rows = []
            for text in b.column(1).to_pylist():
                stored = store(payload(text))
                back = load(stored)
                rows.append((len((text or "").encode()), stored, back, fingerprint(back)))
            n, m, p, f = zip(*rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(m, pa.binary()), pa.array(p, pa.binary()), pa.array(f, pa.list_(pa.int64()))], names=["doc_id", "n_bytes", "media", "payload", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def query(docs: DataFrame) -> DataFrame:
    m = media_columns(docs)
    return m.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, octet_length(payload) - 31)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.sha2(F.array_join("fingerprint", ",").cast("binary"), 256).alias("feature"),
    )
