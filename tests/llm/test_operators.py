"""The operators against brute force, exact round trips and held-out accuracy on small fixtures."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from chronolap.llm import bpe, langid, licenses, lines, media, near, packing, scoring, substrings, topk
from chronolap.session import table

SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "a", "A b", "a b", "12 34", "\n\n", "x\ty  z\r\n", "ﬀ İstanbul ςΣ ñandú", "日本語 テスト", "a b\x1cc 　d", "don't we'll 123456 ...!!", "word " * 3000, "q" * 3000, "a b c", "a b c"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").cache()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, "s", "clash", 0.5) for i, t in enumerate(ODD)], "doc_id long, text string, lang string, source string, component string, score double")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def test_bpe(docs, odd, none):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    args = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    for d in (docs, odd):
        want = {r[0]: r[1] or "" for r in d.select("doc_id", "text").collect()}
        for r in bpe.bpe(d, *args).collect():
            assert list(memoryview(bytes(r.ids)).cast("I")) == enc.encode_ordinary(want[r.doc_id]), repr(want[r.doc_id][:60])
            assert bytes(r.decoded).decode() == want[r.doc_id]
    assert bpe.query(none, *args).count() == 0


def test_packing(docs, odd, none):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    for d in (docs, odd):
        rows = packing.query(d, P.path("word_bpe_49k.json")).collect()
        by, bins = defaultdict(list), defaultdict(list)
        for r in rows:
            by[r.doc_id].append(r)
            bins[r.sequence_id].append((r.offset, r.length))
        for i, text in d.select("doc_id", "text").collect():
            ids = t.encode(text or "", add_special_tokens=False).ids + [0]
            got = sorted(by[i], key=lambda r: r.piece)
            cut = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
            assert [(r.piece, r.start, r.length, r.ids_crc32) for r in got] == [(k, k * 2048, len(c), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in c))) for k, c in enumerate(cut)]
        for b in bins.values():
            at = 0
            for o, n in sorted(b):
                assert o == at
                at += n
            assert at <= 2048
        total = sum(r.length for r in rows)
        assert len(bins) <= 1.1 * -(-total // 2048) + 1 or d is not docs or len(bins) <= sum(r.length > 1024 for r in rows) + 2
    assert packing.query(none, P.path("word_bpe_49k.json")).count() == 0


def test_media(odd, none):
    for r in media.media_columns(odd).collect():
        raw = (ODD[r.doc_id] or "").encode()
        assert bytes(r.payload).startswith(raw) and len(r.payload) % 576 == 0 and len(r.payload) > 0
        assert media.load(bytes(r.media)) == bytes(r.payload)
    q = {r.doc_id: r for r in media.query(odd).collect()}
    p = media.payload(ODD[13])
    assert q[13].payload_sha256 == hashlib.sha256(p).hexdigest() and q[13].tail_crc32 == zlib.crc32(p[-32:])
    assert q[15].feature == q[16].feature and q[0].feature == q[1].feature
    assert media.query(none).count() == 0


def test_topk(spark):
    e = table(spark, SF, "embeddings").select("vec_id", "embedding")
    bad = spark.createDataFrame([(900000, None), (900050, [1.0, None]), (900100, [float("nan")]), (900150, [float("inf")] * 64), (900200, [0.5] * 70), (900201, [1e9] * 64)], "vec_id long, embedding array<float>")
    import numpy as np

    all_ = e.union(bad)
    rows = [(r[0], np.floor(256 * np.array(r[1], dtype=np.float64))) for r in all_.collect() if r[0] < 900000 or r[0] in (900200, 900201)]
    v = {i: np.pad(x, (0, 70 - len(x))) for i, x in rows}
    want = []
    for q in (i for i in v if i % 50 == 0):
        s = sorted(((-int(v[q] @ v[i]), i) for i in v if i != q))[:5]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert sorted(map(tuple, topk.topk(all_).collect())) == sorted(want)
    assert topk.topk(e.limit(0)).count() == 0


def components(sets, percent):
    root = list(range(len(sets)))

    def top(i):
        return i if root[i] == i else top(root[i])

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for i, s in enumerate(sets):
        n = Counter(j for x in s for j in where[x] if j < i)
        for j, both in n.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(sets))]


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near(spark, docs, odd, none, k, percent):
    crowd = " ".join(f"w{i}" for i in range(60)).split()
    many = spark.createDataFrame([(10_000 + i, " ".join(crowd[:i % 60] + [f"x{i}"] + crowd[i % 60 + 1 :]) if i % 3 else " ".join(crowd)) for i in range(700)], "doc_id long, text string")
    for d in (docs, odd, many):
        rows = sorted(d.select("doc_id", "text").collect())
        sets = []
        for _, t in rows:
            w = WORD.findall(low(t))
            sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
        want = components(sets, percent)
        got = {r.doc_id: r for r in near.near_duplicates(d, k, percent).collect()}
        assert len(got) == len(rows)
        for i, (doc, _) in enumerate(rows):
            assert (got[doc].n_shingles, got[doc].component_id, got[doc].kept) == (len(sets[i]), rows[want[i]][0], want[i] == i)
    assert near.near_duplicates(none, k, percent).count() == 0


@pytest.mark.parametrize("small", [0, 1000])
def test_components(spark, small):
    e = [(i, i + 1) for i in range(40)] + [(90, 70), (70, 80), (60, 60), (70, 90)] + [(100 + i * 7 % 30, 130) for i in range(30)]
    want = {i: 0 for i in range(41)} | {70: 70, 80: 70, 90: 70} | {100 + i: 100 for i in range(31)}
    got = near.components(spark.createDataFrame(e, "a long, b long"), small).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want
    assert near.components(spark.createDataFrame([], "a long, b long"), small).count() == 0


def test_language(docs, odd, none):
    got = {r.doc_id: r for r in langid.query(docs).collect()}
    held = [(r.lang, got[r.doc_id].lang_pred) for r in docs.collect() if got[r.doc_id].held_out]
    assert len(held) > 100 and sum(a == b for a, b in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    mixed = odd.select("doc_id", "text", "lang").union(docs.select("doc_id", "text", "lang").where("doc_id > 100"))
    und = {r.doc_id for r in langid.query(mixed).where("doc_id <= 100").collect() if r.lang_pred == "und"}
    assert und == {0, 1, 2, 6, 7}
    assert langid.query(none).count() == 0 and {r.lang_pred for r in langid.query(odd).collect()} == {"und"}
    assert langid.stage(docs).columns == docs.columns and langid.stage(docs).count() == docs.count()


def test_lines(spark, docs, odd, none):
    base = [f"t{i}" for i in range(20)]
    extra = spark.createDataFrame([(5000 + i, "\n".join([" ".join(base[: 20 - i % 5]), " ".join(base[i % 7 :] + [f"u{i % 11}"]), "", "a b c d e", "a b c d"])) for i in range(40)] + [(6000, None)], "doc_id long, text string")
    for d in (docs.where("doc_id < 250"), odd, extra):
        rows = sorted(d.select("doc_id", "text").collect())
        seen, where, want = [], defaultdict(list), {}
        for doc, t in rows:
            want[doc] = []
            for k, x in enumerate((t or "").split("\n")):
                s = set(WORD.findall(low(x)))
                n = Counter(j for w in s for j in where[w])
                if any(10 * b >= 8 * (len(s) + len(seen[j]) - b) for j, b in n.items()):
                    want[doc].append(k)
                for w in s:
                    where[w].append(len(seen))
                seen.append(s)
        got = {r.doc_id: r for r in lines.query(d).collect()}
        assert {k: r.removed_lines for k, r in got.items()} == want
        for doc, t in rows:
            assert got[doc].text == (t and "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[doc]))
    assert lines.query(none).count() == 0


def test_substrings(spark, odd, none):
    import random

    r = random.Random(4)
    text = lambda n: [f"{r.choice('abcdefgh')}{r.randrange(4000)}" for _ in range(n)]
    shared, near_ = text(80), text(90)
    edit = near_[:45] + ["changed"] + near_[46:]
    parts = [(1, text(200) + shared + text(50)), (2, text(60) + shared), (3, shared + text(300)), (4, text(100) + near_), (5, edit + text(70)), (6, text(400)), (7, text(60) + shared[:40] + text(60))]
    parts += [(8, parts[5][1]), (9, parts[5][1]), (10, ["twice"] + text(48)), (11, [])]
    parts += [(12, parts[9][1]), (13, [])]
    got = {x.doc_id: x for x in substrings.query(spark.createDataFrame([(i, " ".join(t)) for i, t in parts], "doc_id long, text string")).collect()}
    assert [got[i].n_removed for i in (1, 4, 6, 7)] == [0, 0, 0, 0]
    assert got[2].spans == [[60, 140]] and got[3].spans == [[0, 80]] and got[5].spans == [[0, 90]]
    # copies of a long text are one passage; copies below the least length stay
    assert got[8].spans == got[9].spans == [[0, 400]] and [got[i].n_removed for i in (10, 11, 12, 13)] == [0, 0, 0, 0]
    assert substrings.query(odd).count() == len(ODD) and substrings.query(none).count() == 0


def test_scoring(docs, odd, none):
    train, rows = Counter(), docs.select("doc_id", "text").collect()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update([*WORD.findall(low(t)), None])
    n, v = sum(train.values()), len(train)
    better = 0
    got = {r.doc_id: r for r in scoring.score(docs).collect()}
    for i, t in rows:
        w = [*WORD.findall(low(t)), None]
        g = got[i]
        assert g.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) and g.train_tokens == n
        assert (g.n_tokens, g.n_known) == (len(w), sum(train[x] > 0 for x in w))
        assert abs(g.base_score - sum(log10((train[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 * len(w)
        better += g.score > g.base_score if g.held_out else 0
    held = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in held) > sum(g.base_score for g in held) and better > 0.8 * len(held)
    assert scoring.score(odd).count() == len(ODD) and scoring.score(none).count() == 0


def test_licenses(docs, odd, none):
    assert licenses.patience("a b c d e".split(), "a x c d e".split()) == [(0, 0), (2, 2), (3, 3), (4, 4)]
    t = {k: licenses.tokens(v) for k, v in licenses.TEMPLATES.items()}
    for k, v in licenses.TEMPLATES.items():
        found = [x[0] for x in licenses.scan(f"some words before. {v}\nand after it", t)]
        assert k in found and {x.split("/")[0] for x in found} == {k.split("/")[0]}
    assert licenses.scan("the work was released to the public", t) == []
    marks = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    got = {r.doc_id: r.licenses.split(",") for r in licenses.query(docs).collect()}
    for r in docs.collect():
        for text, name in marks.items():
            assert (text not in r.text) or name in got[r.doc_id]
    assert licenses.query(odd).count() == len(ODD) and licenses.query(none).count() == 0


def planted(seed, vocabulary=40000):
    import random

    r = random.Random(seed)
    return r, lambda n: [f"{r.choice('abcdefgh')}{r.randrange(vocabulary)}" for _ in range(n)]


def spans_of(spark, parts):
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in parts], "doc_id long, text string").repartition(5)
    return {x.doc_id: x.spans for x in substrings.query(d).collect()}


def test_passages_follow_every_occurrence(spark):
    _, text = planted(1)
    p = text(60)
    # the earlier text quotes 16 words of the passage before it has all of it; 8 has it twice, and quotes a part of it
    a = [*text(30), *p[:16], *text(270), *p, *text(40)]
    b = [*text(20), *p, *text(80)]
    got = spans_of(spark, [(1, a), (5, b), (8, [*text(30), *p[30:38], *text(100), *p, *text(30), *p])])
    assert got == {1: [], 5: [[20, 80]], 8: [[138, 198], [228, 288]]}


def test_passages_inside_one_text(spark):
    _, text = planted(2)
    p = text(70)
    assert spans_of(spark, [(1, [*p, *text(40), *p, *text(9)])]) == {1: [[110, 180]]}
    # words that repeat without end: the first 50, what links them and less than EVERY at the end stay
    (got,) = spans_of(spark, [(1, ["word"] * 200_000)]).values()
    assert len(got) == 1 and got[0][0] < 100 and got[0][1] > 200_000 - 16


def test_passages_beside_other_text(spark):
    r, text = planted(3)
    a = text(300)
    b = [x if i % 10 < 5 else y for i, (x, y) in enumerate(zip(a, text(300)))]
    b[:60] = a[:60]
    got = spans_of(spark, [(1, a), (2, b), (3, b[100:])])
    assert got[1] == [] and got[2] == [[0, 75]] and got[3] == [[0, 200]]


def test_recall_of_near_passages(spark):
    """Passages of 60 to 100 words with a share of 0.85 to 0.95 of their five-word shingles, against what was planted."""
    r, text = planted(4)
    parts, want = [], {}
    for k in range(120):
        p = text(r.randrange(60, 100))
        q = list(p)
        for i in r.sample(range(3, len(p) - 3), 2):
            q[i : i + 1] = r.choice([text(1), [], [q[i], *text(1)]])
        at = r.randrange(5, 60)
        parts += [(k, [*text(r.randrange(80)), *p, *text(20)]), (1000 + k, [*text(at), *q, *text(r.randrange(80))])]
        want[1000 + k] = at, at + len(q)
    got = spans_of(spark, parts)
    assert not any(got[k] for k in range(120))
    caught = sum(sum(max(0, min(e, b) - max(s, a)) for a, b in got[k]) for k, (s, e) in want.items())
    wrong = sum(sum((b - a) - max(0, min(e, b) - max(s, a)) for a, b in got[k]) for k, (s, e) in want.items())
    assert caught >= 0.9 * sum(e - s for s, e in want.values()) and wrong == 0


def test_windows_against_brute_force():
    import numpy as np

    r = np.random.default_rng(5)
    for sizes in ([300, 0, 20, 46, 1, 500], [45], [46], [2000]):
        h = r.integers(0, 200 if len(sizes) > 1 else 2**62, sum(sizes)).astype(np.uint64) * np.uint64(4)
        ends, want = np.cumsum(sizes), set()
        for e, n in zip(ends, sizes):
            todo = [(int(e) - n, int(e))]
            while todo:
                lo, hi = todo.pop()
                if hi - lo >= 46:
                    c = lo + int(h[lo:hi].argmin())
                    want.add((lo, c, hi))
                    todo += [(lo, c), (c + 1, hi)]
        got = set(map(tuple, substrings.windows(h, ends).tolist()))
        assert got <= want and all(any(a == b and h[c] == h[d] for a, d, b in [(hi, k, hi2) for _, k, hi2 in got]) for lo, c, hi in want - got for a, b in [(hi, hi)]) or got == want


def test_substrings_of_repeated_ids_and_clashing_names(spark):
    _, text = planted(6)
    p, q = text(60), text(60)
    rows = [(1, " ".join(p + text(5)), 1), (2, " ".join(q), 2), (2, " ".join(text(9) + p), 3), (2, "short", 4), (None, " ".join(p), 5), (3, " ".join(q), 6), (2, " ".join(q), 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _words int")
    got = {r[2]: r[1].split() for r in substrings.stage(d).collect()}
    assert got == {1: rows[0][1].split(), 2: q, 3: rows[2][1].split()[:9], 4: ["short"], 5: p}
    assert substrings.stage(d).columns == d.columns


def test_substrings_past_unrelated_windows(spark):
    import random

    r = random.Random(0)
    text = lambda n: [f"{r.choice('abcdefgh')}{r.randrange(40000)}" for _ in range(n)]
    shared = text(50)
    # every five words of the passage also stand alone in unrelated documents before and between
    alone = lambda: [x for k in range(46) for x in [*shared[k : k + 5], *text(60)]]
    parts = [*((i, alone()) for i in (*range(10), *range(11, 30))), (10, text(90) + shared + text(20)), (30, text(50) + shared + text(80)), (31, text(40))]
    got = {x.doc_id: x for x in substrings.query(spark.createDataFrame([(i, " ".join(t)) for i, t in parts], "doc_id long, text string")).collect()}
    assert [got[i].n_removed for i in (*range(30), 31)] == [0] * 31
    assert got[30].spans == [[50, 100]]


def test_language_of_few_texts_in_a_large_table(spark):
    rows = [(i, f"the common text number {i} of many", "xx") for i in range(2000)] + [(5000 + i, f"zzq qzz vvk {i}", "yy") for i in range(12)]
    rows += [(6000 + i, "wij wij jiw", "zz") for i in range(60)] + [(7000 + i, f"jiw wij jjw {i}", "zz") for i in range(8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = langid.sample(d, 10)
    want = {(t, k) for i, t, k in rows if zlib.crc32(str(i).encode()) % 4 != 2 and k != "xx"}
    assert len(want) > 10 and {x for x in map(tuple, got) if x[1] != "xx"} == want
    assert len(got) == len(set(got)) == len(want) + 10
    assert langid.sample(d.limit(0), 10) == []


def test_licenses_changed_or_repeated():
    t = {k: licenses.tokens(v) for k, v in licenses.TEMPLATES.items()}
    # the text's rarest template word stands elsewhere
    text = "Distributed under the MIT License. " + "other words " * 30 + "it was released " + "more words " * 30 + "Distributed under the MIT License."
    assert [x[0] for x in licenses.scan(text, t)] == ["MIT"]
    for k, v in licenses.TEMPLATES.items():
        assert k in [x[0] for x in licenses.scan(f"some words {v} {v} {v} and after it", t)]
    assert licenses.scan("the license under which the work was released is not the one of mit", t) == []


def test_licenses_need_their_telling_words():
    t = {k: licenses.tokens(v) for k, v in licenses.TEMPLATES.items()}
    for x in ("Licensed under CC BY 4.0.", "Released under the BSD License.", "Licensed under the Apache License, Version 1.1."):
        assert licenses.scan(x, t) == []
    assert [x[0] for x in licenses.scan("Licensed under CC BY 4.0. Licenced under CC BY-NC 4.0.", t)] == ["CC-BY-NC-4.0"]


def test_stages_keep_rows_without_id_or_label(spark):
    d = spark.createDataFrame([(1, "one two three four five six", None), (2, "one two three four five six", None), (None, "a clean text of its own", None), (3, None, None), (4, "12 34", None)], "doc_id long, text string, lang string")
    assert sorted(r.text for r in langid.stage(d).collect()) == sorted(["one two three four five six"] * 2 + ["a clean text of its own"])
    assert sorted(((r.doc_id or 0), r.text) for r in near.stage(d.where("text is not null")).collect()) == [(0, "a clean text of its own"), (1, "one two three four five six"), (4, "12 34")]
    assert near.stage(d).columns == d.columns


def brute_lines(rows):
    """Places of the lines that an earlier one (doc_id, place) is like, by document."""
    seen, where, want = [], defaultdict(list), {}
    for doc, t in rows:
        want[doc] = []
        for k, x in enumerate((t or "").split("\n")):
            s = set(WORD.findall(low(x)))
            n = Counter(j for w in s for j in where[w])
            if any(10 * b >= 8 * (len(s) + len(seen[j]) - b) for j, b in n.items()):
                want[doc].append(k)
            for w in s:
                where[w].append(len(seen))
            seen.append(s)
    return want


def test_lines_of_large_clusters(spark):
    import random

    r = random.Random(3)
    base = [f"w{i}" for i in range(40)]

    def copy(changes):
        t = list(base)
        for i in r.sample(range(40), changes):
            t[i] = f"x{r.randrange(300)}"
        return " ".join(t)

    # the line that most others are like comes late; before it stand near misses of one another
    rows = [(i, "\n".join(copy(r.choice([4, 5, 6, 7])) for _ in range(3))) for i in range(150)] + [(200, " ".join(base))]
    rows += [(300 + i, "\n".join([copy(5), "the one common line of all documents", copy(6)])) for i in range(60)]
    got = {x.doc_id: x.removed_lines for x in lines.query(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert got == brute_lines(rows)


def test_lines_of_repeated_ids_and_clashing_names(spark):
    rows = [(1, "a b c d e f\nonly here", 7.5, 1), (2, "one line\na b c d e f", 7.5, 2), (2, "another text\na line of its own that stays", 7.5, 3), (None, "a b c d e f", 7.5, 4), (2, "one line\na b c d e f", 7.5, 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _removed double, doc int")
    got = sorted(tuple(r) for r in lines.stage(d).collect() if r[0])
    assert got == sorted([(1, "only here", 7.5, 1), (2, "one line", 7.5, 2), (2, "another text\na line of its own that stays", 7.5, 3), (2, "one line", 7.5, 2)])
    assert [tuple(r) for r in lines.stage(d).collect() if not r[0]] == [(None, "a b c d e f", 7.5, 4)]
    assert lines.stage(d).columns == d.columns


def test_packing_with_a_small_word_table(docs, monkeypatch):
    import numpy as np
    import pyarrow as pa

    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            return f

    texts = [r.text for r in docs.select("text").limit(200).collect()]
    b = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t])], names=["doc_id", "text"]) for i, t in enumerate(texts)]
    run = packing.pieces(Frame(), P.path("word_bpe_49k.json"))
    got = []
    for entries in (1 << 20, 900):
        monkeypatch.setattr(packing, "ENTRIES", entries)
        packing._LOADED.clear()
        got.append([(r["doc_id"], r["ids"]) for x in run(iter(b)) for r in x.to_pylist()])
        assert len(packing._LOADED[P.path("word_bpe_49k.json")][1].keys) <= entries
    packing._LOADED.clear()
    assert got[0] == got[1] and np.frombuffer(got[0][0][1], np.uint32)[-1] in (0, *np.frombuffer(got[0][0][1], np.uint32))


def test_near_repeated_and_missing_ids(spark):
    w = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    rows = [(5, " ".join(other)), (5, " ".join(w)), (9, " ".join([*w[:59], "x"])), (12, " ".join(["y", *other[1:]])), (None, " ".join(w[1:])), (None, "one of its own with five words"), (3, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [((r.doc_id or 0), r.component_id, r.kept) for r in near.near_duplicates(d, 3, 85).collect()]
    assert sorted(got, key=str) == sorted([(5, 5, True), (5, 5, True), (9, 5, False), (12, 5, False), (0, 5, False), (0, None, True), (3, 3, True)], key=str)


def test_forest_goes_deeper_where_it_is_dense():
    import numpy as np

    r = np.zeros(300, near._PLACE)
    r["node"] = np.arange(300)[::-1]
    r["rest"][:, 0], r["rest"][:, 1] = np.arange(300) // 100, np.arange(300) // 10
    pairs = near.candidates(r, dense=50)
    heads = {(a, b) for a, b in pairs.tolist() if a - b > 1}
    assert all(a // 10 == b // 10 and b % 10 == 0 for a, b in heads) and len(pairs) >= 299
    assert {b for _, b in near.candidates(r, dense=400)[299:].tolist()} == {0}


def test_parity_bits_never_drop_a_link():
    import numpy as np

    g = np.random.default_rng(8)
    base = g.integers(1, 2**63, 400).astype(np.uint64)
    found = [np.unique(np.r_[base[: 400 - k], g.integers(1, 2**63, k).astype(np.uint64)]) for k in range(0, 80, 4)]
    for i in found:
        for j in found:
            differ = len(np.setxor1d(i, j))
            assert np.bitwise_count(near.parity(i) ^ near.parity(j)).sum() <= differ


def test_topk_of_repeated_ids(spark):
    v = [[1.0, 2.0], [1.0, 2.0], [3.0, 0.5], [0.0, 1.0]]
    d = spark.createDataFrame([(50, v[0]), (50, v[1]), (50, v[2]), (7, v[3])], "vec_id long, embedding array<float>")
    rows = [(50, v[0]), (50, v[1]), (50, v[2]), (7, v[3])]
    want = []
    for i, (q, a) in enumerate(rows):
        if q % 50 == 0:
            s = sorted((-sum(int(256 * y) * int(256 * z) for y, z in zip(a, b)), e) for j, (e, b) in enumerate(rows) if j != i)[:5]
            want += [(q, k + 1, e, -n) for k, (n, e) in enumerate(s)]
    assert sorted(map(tuple, topk.topk(d).collect())) == sorted(want)


def test_topk_leaves_blocks_out():
    """On vectors in clusters most blocks are never scored; on vectors without any order none can be left out."""
    import numpy as np

    r = np.random.default_rng(2)
    centres = 256 * np.eye(32)[r.integers(0, 32, 16384)]
    d = np.floor(centres + 8 * r.random((16384, 32)))
    scored = []
    topk.search(np.arange(40), d[:40], np.arange(16384), d, 5, scored)
    assert sum(scored) < 0.5 * 40 * 32
    print("blocks scored:", sum(scored), "of", 40 * 32)


def test_language_keeps_clashing_columns(spark, docs):
    d = docs.select("doc_id", "text", "lang").selectExpr("*", "7.5D as score", "'mine' as lang_pred", "doc_id as _letter")
    got = langid.stage(d)
    assert got.columns == d.columns and got.where("score <> 7.5 or lang_pred <> 'mine' or _letter <> doc_id").count() == 0
    null = langid.query(docs.selectExpr("cast(null as long) as doc_id", "text", "lang").limit(3))
    assert [r.held_out for r in null.collect()] == [False] * 3


def test_license_texts_apart_from_like_ones():
    t = {k: licenses.tokens(v) for k, v in licenses.TEMPLATES.items()}
    lesser = licenses.TEMPLATES["LGPL-2.1/header"].replace("2.1", "3")
    assert licenses.scan(lesser, t) == [] and licenses.scan("This work is licensed under the GNU Lesser General Public License, version 3.", t) == []
    old = licenses.TEMPLATES["GPL-3.0/header"].replace("version 3", "version 2")
    assert [x[0] for x in licenses.scan(old, t)] == ["GPL-2.0/header"]
    # a permission text that lost words in its middle, far into other text
    words = licenses.TEMPLATES["MIT/text"].split()
    text = "a b c " * 500 + " ".join(words[:30] + words[42:]) + " d e f" * 500
    assert [x[0] for x in licenses.scan(text, t)] == ["MIT/text"]
    assert licenses.scan(" ".join(words[:40]), t) == []
