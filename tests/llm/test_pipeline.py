"""The five stages together, against a plain version of each on a small table."""

import sys
import zlib
from pathlib import Path

import public_tokenizers as P
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_operators import WORD, brute_lines, components, low, planted  # noqa: E402

import corpus_pipeline  # noqa: E402
from chronolap.llm import scratch  # noqa: E402


def wrap(words, n):
    return "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))


def brute(rows):
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    gone = brute_lines(rows)
    rows = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])) for i, t in rows]
    rows = [(i, t) for i, t in rows if WORD.search(t)]
    sets = []
    for _, t in rows:
        w = WORD.findall(low(t))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    rows = [x for k, x in enumerate(rows) if components(sets, 80)[k] == k]
    seen, out = set(), []
    for i, t in rows:  # passages of 50 words that an earlier text has
        w, mine = WORD.findall(t), [tuple(WORD.findall(low(t))[k : k + 50]) for k in range(len(WORD.findall(t)) - 49)]
        drop = {k + j for k, x in enumerate(mine) if x in seen for j in range(50)}
        seen.update(mine)
        out.append((i, t, [x for k, x in enumerate(w) if k not in drop]))
    return out


def test_pipeline_against_plain_stages(spark, tmp_path):
    r, text = planted(9)
    own = [text(120) for _ in range(25)]
    passage = text(60)
    rows = [(i, wrap(w, 15)) for i, w in enumerate(own)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, wrap([*own[4][:7], "x", *own[4][8:]], 15)), (103, wrap(own[5], 10)), (104, wrap(own[6], 8))]
    rows += [(200, " ".join(passage) + "\n" + wrap(text(40), 9)), (201, wrap([*text(30), *passage, *text(33)], 21)), (300, None), (301, "12 34\n\n"), (302, "")]
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in rows]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute([(x[0], x[1]) for x in rows])
    assert {100, 101, 102, 103, 104, 300, 301, 302}.isdisjoint(i for i, _, _ in want) and any(len(w) < len(WORD.findall(t)) for _, t, w in want)
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    ids = {i: t.encode(" ".join(w), add_special_tokens=False).ids + [0] for i, _, w in want}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id: (x.length, x.ids_crc32) for x in got} == {i: (len(x), zlib.crc32(b"".join(y.to_bytes(4, "little") for y in x))) for i, x in ids.items()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "substring_dedup", "best_fit_packing"]


def test_stages_on_odd_tables(spark, tmp_path):
    rows = [(1, "a b c d e f g", None, "s", 1, 0.5, "m"), (1, "a b c d e f g", None, "s", 1, 0.5, "m"), (None, "a text without an id", "en", None, None, None, None), (2, None, "en", "s", 0, 1.5, "n"), (3, "word " * 5000, "en", "s", 1, 2.5, "o")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, _removed string")
    for docs in (d, d.limit(0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = scratch.write(stage(spark, docs, str(tmp_path)), name)
            if k < 4:
                assert docs.columns == d.columns
        assert docs.count() >= 0
