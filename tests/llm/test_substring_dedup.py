import hashlib
import random
import re

from lodestream.llm.substring_dedup import substring_dedup


def brute(rows, n=13):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - n + 1):
            first.setdefault(tuple(words[d][i : i + n]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone |= set(range(i, i + n))
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


def test_equals_brute_force(spark):
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(60)] + ["é", "日本"]
    passage = [[r.choice(vocab) for _ in range(r.choice([12, 13, 14, 30, 60]))] for _ in range(12)]
    texts = [None, "", " \n\t", "a b c", "x\x1cy\x85z"]
    for _ in range(120):
        w = []
        for _ in range(r.randrange(1, 5)):
            w += [r.choice(vocab) for _ in range(r.choice([0, 3, 20]))] + (r.choice(passage) if r.random() < 0.7 else [])
        texts.append(" ".join(w))
    texts += [texts[20], texts[20], texts[30] + "\n", "same words " * 30, "a b c"]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, [1]) for i, t in rows], "doc_id long, text string, runs array<int>").repartition(5)
    out, spans = substring_dedup(df)
    want = brute(rows)
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in out.collect()} == want
    for x in spans.collect():
        assert sum(s["last"] - s["first"] + 1 for s in x.spans) == want[x.doc_id][1]


def test_empty_table(spark):
    out, spans = substring_dedup(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and spans.count() == 0


def test_factors_follow_one_reference_and_rows_of_one_id_keep_apart(spark):
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(["x"] + a[5:25] + b[:20])), (4, " ".join(a[:20])), (4, " ".join(["own"] * 3 + b[3:20]))]
    out, spans = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in out.collect()) == [(1, 30, 0), (2, 30, 0), (3, 41, 40), (4, 20, 17), (4, 20, 20)]
    got = {r.doc_id: r for r in spans.where("doc_id = 3").collect()}[3]
    assert [(s.first, s.last) for s in got.spans] == [(1, 40)]
    assert [(f.first, f.last, f.ref, f.ref_pos & 0xFFFFFFFF) for f in got.factors] == [(1, 20, 1, 5), (21, 40, 2, 0)]


def test_a_factor_that_differs_from_its_reference_is_kept(spark):
    from pyspark.sql import functions as F

    from lodestream.llm.substring_dedup import FACTORS, SPANS, recut
    import zstandard
    from lodestream.llm.common import Texts
    import pyarrow as pa

    schema = f"doc_id long, at long, n_removed long, cut_sha string, {SPANS}, {FACTORS}"
    cut = spark.createDataFrame([(7, 0, 4, "", [], [(0, 1, 1, 0, b""), (4, 5, 1, 9, b"")]), (8, 0, 1, "same", [], [])], schema)
    texts = spark.createDataFrame([(7, 0, bytearray(zstandard.ZstdCompressor().compress(b"a b c d e f")), [1])], "doc_id long, at long, packed binary, anchors array<long>")
    wrong = spark.createDataFrame([(7, 0, 0, 1)], "doc_id long, at long, first long, last long")
    unpacked = lambda column: Texts(pa.array([zstandard.ZstdDecompressor().decompress(x).decode() for x in column.to_pylist()], pa.string()))
    got = {r.doc_id: r for r in recut(cut, wrong, texts, unpacked, schema).withColumn("k", F.size("factors")).collect()}
    assert (got[7].n_removed, got[7].cut_sha, got[7].k) == (2, hashlib.sha256(b"a b c d").hexdigest(), 1)
    assert got[8].cut_sha == "same"


def test_repeats_inside_a_text_are_found_at_every_place(spark):
    run = [f"r{i}" for i in range(15)]
    rows = [(1, " ".join(run)), (2, " ".join(["x"] + run + ["y", "z"] + run + run)), (3, " ".join(run * 4))]
    out, spans = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in out.collect()} == brute(rows)
    got = {r.doc_id: [(f.first, f.last, f.ref) for f in r.factors] for r in spans.collect()}
    assert got[2][:2] == [(1, 15, 1), (18, 32, 1)]


def test_hashes_and_minima_of_neighbours():
    import numpy as np
    from lodestream.llm.substring_dedup import first_places, least, run_hashes

    r = np.random.default_rng(2)
    h = r.integers(0, 3, 400).astype(np.uint64)
    for k in range(1, 16):
        assert least(h, k).tolist() == [min(h[i : i + k]) for i in range(len(h) - k + 1)]
        got = run_hashes(h, k).tolist()
        want = [tuple(h[i : i + k]) for i in range(len(h) - k + 1)]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))
        assert len(run_hashes(h[: k - 1], k)) == 0
    doc, run = np.repeat([0, 1], 200), h
    first = {}
    for i, x in enumerate(zip(doc.tolist(), run.tolist())):
        first.setdefault(x, i)
    assert sorted(first_places(doc, run).tolist()) == sorted(first.values()) and len(first_places(doc[:0], run[:0])) == 0


def test_a_text_is_cut_at_about_the_cost_of_splitting_it():
    """Words were sliced out of the batch one by one, at some eight times the cost of splitting the text."""
    import time

    import numpy as np
    import pyarrow as pa
    from lodestream.llm import substring_dedup as s
    from lodestream.llm.common import Texts

    text = " ".join(f"w{i % 977}" for i in range(300_000))
    t = Texts(pa.array([text]))
    w, keep = t.words(), np.arange(300_000) % 30 > 0

    def cost(f):
        best = 1e9
        for _ in range(3):
            begin = time.process_time()
            f()
            best = min(best, time.process_time() - begin)
        return best

    digest = (lambda: s.kept_digest(s.text_words(t, 0), keep)) if hasattr(s, "text_words") else lambda: s.kept_digest(t, w, 0, keep)
    assert digest() == hashlib.sha256(" ".join(x for i, x in enumerate(text.split()) if i % 30).encode()).hexdigest()
    plain = text.encode()
    assert cost(digest) < 5 * cost(lambda: hashlib.sha256(b" ".join(plain.split())).hexdigest())
