"""The stages on the smallest tables and on rows with nulls: each keeps what it should and returns the columns of documents."""

import os
import random

import pytest

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    out = P.run(spark, SF).collect()
    assert out and {r.doc_id for r in out} <= ids
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in out)


def test_stages_on_odd_rows(spark):
    long = "every clean document of this small corpus has its own line of words here {}"
    rows = [(i, long.format(" ".join(f"w{i}x{j}" for j in range(12))), "en", "s1" if i % 2 else None, 10) for i in range(20)]
    rows += [(20, rows[3][1], "en", "s1", 10), (21, rows[4][1] + "\nmore words that only this one document holds in its second line", None, "s2", 10)]
    rows += [(None, rows[5][1], "en", "s1", 10), (22, None, "en", "s1", 0), (23, "", None, None, 0), (24, "too short", "en", "s1", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = {}
    for name, stage in P.STAGES[:-1]:
        docs = P.checkpoint(stage(spark, docs, ""))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["quality_rules"]) == {*range(22), None}
    assert set(kept["line_dedup"]) == {*range(20), 21, None}
    assert kept["line_dedup"][21] == "more words that only this one document holds in its second line"
    assert set(kept["ngram_jaccard"]) == set(kept["mixing"]) == {*range(20), 21, None}
    assert P.STAGES[-1][1](spark, docs, "").count() >= 22


def test_stages_equal_brute_force(spark):
    """Line dedup, near duplicates and token ids of the stages against the operators' brute-force versions."""
    spm = pytest.importorskip("sentencepiece")
    from test_line_dedup import brute as lines_brute
    from test_ngram_jaccard import brute as near_brute

    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdeinorst") for _ in range(r.randrange(2, 9)))
    shared = [" ".join(word() for _ in range(12)) for _ in range(6)]
    rows = []
    for i in range(50):
        own = [" ".join(word() for _ in range(14)) for _ in range(r.randrange(2, 5))]
        rows.append((i, "\n".join(own + r.sample(shared, r.randrange(0, 3)))))
    for i in range(50, 65):  # near copies: one word of every line differs twice, so that no line matches
        near = [x.split() for x in rows[i - 50][1].split("\n")]
        for w in near:
            for k in r.sample(range(len(w)), 1 if len(w) > 12 else 2):
                w[k] = word()
        rows.append((i, "\n".join(" ".join(w) for w in near)))
    docs = spark.createDataFrame([(i, t, "xx", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int").repartition(4)
    kept = P.checkpoint(P.STAGES[0][1](spark, docs, ""))
    assert {x.doc_id for x in kept.collect()} == {i for i, _ in rows}
    got = P.checkpoint(P.STAGES[1][1](spark, kept, ""))
    gone = lines_brute(rows, 8)
    want = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get(i, [])) for i, t in rows}
    want = {i: t for i, t in want.items() if t.strip()}
    assert {x.doc_id: (x.text, x.n_chars) for x in got.collect()} == {i: (t, len(t)) for i, t in want.items()}
    near = near_brute(list(want.items()))
    want = {i: t for i, t in want.items() if near[i][1] == i}
    got = P.checkpoint(P.STAGES[2][1](spark, got, ""))
    assert {x.doc_id: x.text for x in got.collect()} == want
    got = P.checkpoint(P.STAGES[3][1](spark, got, ""))
    assert {x.doc_id: x.text for x in got.collect()} == want
    sp = spm.SentencePieceProcessor(model_file=P.PIECES)
    out = P.STAGES[4][1](spark, got, "").collect()
    assert len(out) == got.count() and all(x.ids == sp.encode(want[x.doc_id]) for x in out)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, removed int, component_id int, mix_position int, ids int")
    for _, stage in P.STAGES[:-1]:
        docs = P.checkpoint(stage(spark, docs, ""))
        assert docs.columns[-4:] == ["removed", "component_id", "mix_position", "ids"] and docs.count() == 0
    assert P.STAGES[-1][1](spark, docs, "").count() == 0
