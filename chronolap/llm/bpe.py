"""Operator 10, byte-level BPE: exact merges in linear time by longest matches and backtracking.

Bytes are mapped to Latin-1 so that an Aho-Corasick automaton finds every vocabulary entry in a piece.
From the longest entry at each place the encoder backtracks to shorter ones while an entry and its
neighbour are not compatible, which is the case when merging their joined bytes does not give the two
back; compatibility is memoised. Pieces and whole chunks between spaces are memoised too, in bounded
tables. Null counts as empty text; empty texts give no ids. Extra columns are dropped.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolap.llm import words

SCHEMA = "doc_id long, ids binary, decoded binary"
_MEMO = 400_000


class Encoder:
    """ranks: bytes of each entry -> id; the id is also the order of merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.entries = {b.decode("latin-1"): i for b, i in ranks.items() if self.merge(b) == [i]}  # the others are never a result
        self.longest = max(map(len, self.entries), default=0)
        self.find = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for b in self.entries:
            self.find.add_word(b)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}
        self.old_chunks: dict[str, bytes] = {}
        self.unclean = regex.compile(r"\s\s|^\s|\s$|[^\S \n]")

    def merge(self, raw: bytes) -> list[int]:
        """Plain merging, lowest rank first and leftmost among equals; for short inputs."""
        p = [raw[i : i + 1] for i in range(len(raw))]
        while len(p) > 1:
            best, at = min((self.ranks.get(p[i] + p[i + 1], 1 << 60), i) for i in range(len(p) - 1))
            if best == 1 << 60:
                break
            p[at : at + 2] = [p[at] + p[at + 1]]
        return [self.ranks[x] for x in p]

    def compatible(self, a: int, b: int) -> bool:
        if (ok := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= 4 * _MEMO:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return ok

    def piece(self, raw: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        if (i := self.ranks.get(raw)) is not None:
            return [i]
        text, n, longest, entries = raw.decode("latin-1"), len(raw), self.longest, self.entries
        reach = self.find.longest_prefix
        out: list[tuple[int, int]] = []  # id, size
        ok = [True] * (n + 1)
        pos, size = 0, reach(text[:longest])
        while pos < n:
            while size:
                i = entries.get(text[pos : pos + size])
                if i is not None and ok[pos + size] and (not out or self.compatible(out[-1][0], i)):
                    break
                size -= 1
            if size:
                out.append((i, size))
                pos += size
                size = reach(text[pos : pos + longest])
            else:
                ok[pos] = False
                _, size = out.pop()
                pos -= size
                size -= 1
        return [x[0] for x in out]

    def _chunk(self, chunk: str) -> bytes:
        out = []
        for p in self.pattern.findall(chunk):
            if (got := self.pieces.get(p)) is None:
                if (got := self.old_pieces.get(p)) is None:
                    got = array("I", self.piece(p.encode())).tobytes()
                if len(p) < 64:
                    if len(self.pieces) >= _MEMO:  # a table that is full becomes the old one, so frequent pieces stay
                        self.old_pieces, self.pieces = self.pieces, {}
                    self.pieces[p] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. A space between two other characters starts a piece."""
        if not text or self.unclean.search(text):
            return self._chunk(text)
        if len(self.chunks) >= _MEMO:
            self.old_chunks, self.chunks = self.chunks, {}
        out, memo, old = [], self.chunks, self.old_chunks
        first, *rest = text.split(" ")
        out.append(self._chunk(first))
        for c in rest:
            if (got := memo.get(c)) is None:
                if (got := old.get(c)) is None:
                    got = self._chunk(" " + c)
                if len(c) < 64:
                    if len(memo) >= 2 * _MEMO:
                        memo.clear()
                    memo[c] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


_LOADED: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Encoder(read_ranks(path), pattern)
    return _LOADED[path, pattern]


def bpe(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row for each document: doc_id, ids, and the bytes decoded from them. path is the same on all machines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in words.parts(batches, "text"):
            ids = [e.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(map(e.decode, ids), pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def query(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    return bpe(docs, path, pattern).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
