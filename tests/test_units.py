"""Small cases of what SQL cannot express: sequential rules, loaders, stores, caches, streams."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.functions import text as T
from lodestream.operators import bm25 as B
from lodestream.operators import blocks
from lodestream.operators import cache as K
from lodestream.operators import context as X
from lodestream.operators import dedup as D
from lodestream.operators import dense as N
from lodestream.operators import diversity as V
from lodestream.operators import graph as G
from lodestream.operators import queries as Q
from lodestream.operators import ranking as R
from lodestream.operators import store as S
from lodestream.plans import dialogue as P
from lodestream.sources import loaders as L
from lodestream.streaming import streams


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "query string").select(column(F.col("query")).alias("x")).collect()[0].x


def test_mmr_and_greedy(spark):
    vs = [[1.0, 0.0], [0.99, 0.1], [0.0, 1.0], [0.7, 0.7]]
    df = spark.createDataFrame([(1, i, 1.0 - i / 10, i + 1, v, [1.0, 0.2]) for i, v in enumerate(vs)], "query_id int, chunk_id int, score double, rank int, embedding array<double>, vector array<double>")
    got = [r.chunk_id for r in V.mmr(df, 3, 0.5).orderBy("rank").collect()]
    u = [np.array(v) / np.linalg.norm(v) for v in vs]
    q = np.array([1.0, 0.2]) / np.linalg.norm([1.0, 0.2])
    want = []
    for _ in range(3):
        want.append(max((i for i in range(4) if i not in want), key=lambda i: (0.5 * u[i] @ q - 0.5 * max([u[i] @ u[j] for j in want], default=0), -i)))
    assert got == want
    assert [r.chunk_id for r in V.greedy_diverse(df, 0.9).orderBy("rank").collect()] == [0, 2, 3]


def test_greedy_hamming_is_not_transitive(spark):
    df = spark.createDataFrame([(1, i, i + 1, 0, x) for i, x in enumerate((0, 0b111, 0b111111, 1 << 20))], "query_id int, chunk_id int, rank int, hi long, lo long")
    assert [r.kept_as for r in D.greedy_by_hamming(df).orderBy("rank").collect()] == [1, 1, 3, 1]


def test_query_forms(spark):
    assert one(spark, "What is the Moon?", Q.hypothesis) == "The moon is a concept related to the moon."
    assert one(spark, "best way to cook rice in water", Q.step_back) == "best way to cook rice"
    assert one(spark, "What is X?", lambda c: Q.paraphrases(c)) == ["what", "information about X", "definition of what is x"]
    assert one(spark, "How do cats sleep?", lambda c: Q.variants(c)) == ["How do cats sleep?", "cats sleep?", "sleep? cats", "How do cats sleep"]
    assert one(spark, "cats and dogs; rain", Q.decomposed) == ["cats and dogs; rain"]
    assert one(spark, "large cats and small dogs; rain", Q.decomposed) == ["large cats", "small dogs"]
    df = spark.createDataFrame([('Don\'t use "Big Data" with 3 cafés!',)], "query string")
    r = Q.normalised(df, Q.KEYWORD).collect()[0]
    assert r.tokens == ["use", "Big Data", "cafés"] and r.script == "latin" and "not" in r.removed_stopwords


def test_intents(spark):
    for q, intent, conf in (("define tort", "definitional", 0.6), ("How to file a claim", "procedural", 0.9), ("a vs. b", "comparative", 0.6), ("landmark rulings since 1990", "multi_hop", 0.9), ("who is she", "factual", 0.6), ("hello", "unknown", 0.0)):
        r = Q.classified(spark.createDataFrame([(q,)], "query string")).collect()[0]
        assert (r.intent, r.confidence) == (intent, conf), q


def test_compression(spark):
    text = "Alpha beta gamma. Cats chase mice daily. Nothing here. Cats sleep."
    df = spark.createDataFrame([("cats mice", text), ("zebra", text), ("cats", "")], "query string, content string")
    a, b, c = X.sentence_compressed(df).collect()
    assert a.compressed == "Cats chase mice daily. … Cats sleep." and b.retained == ["Cats chase mice daily."] and c.compressed == ""
    assert [r.compressed for r in X.keyword_compressed(df).collect()][0] == "Cats chase mice daily. … Cats sleep."


def test_graph(spark):
    docs = spark.createDataFrame([(1, "FAISS uses numpy. A 128 dimensions vector."), (2, "Python and Rust are related"), (3, None)], "doc_id long, text string")
    m = G.mentions(docs)
    assert {(r.doc_id, r.key, r.type) for r in m.collect()} >= {(1, "faiss", "TECHNOLOGY"), (1, "128 dimensions", "MEASURE"), (2, "rust", "TECHNOLOGY")}
    rel = {(r.subject, r.predicate, r.obj): r.weight for r in G.relations(G.stated_relations(docs, m)).collect()}
    assert rel["faiss", "USES", "numpy"] == 1.0 and rel["python", "RELATED_TO", "rust"] == 1.0 and rel["faiss", "CO_OCCURS_WITH", "numpy"] == 0.5
    chain = spark.createDataFrame([("a", "P", "b"), ("b", "P", "c"), ("c", "Q", "d")], "subject string, predicate string, obj string")
    start = spark.createDataFrame([("A",)], "start string")
    hops = lambda **k: {r.node: r.hops for r in G.neighbours(chain, start, **k).collect()}
    assert hops(max_hops=2) == {"b": 1, "c": 2} and hops(max_hops=3, predicate="P") == {"b": 1, "c": 2} and hops(max_hops=2, direction="in") == {}


def test_store(spark):
    a = S.with_namespace(spark.createDataFrame([(1, [1.0, 0.0])], "chunk_id long, embedding array<double>"), "x")
    with pytest.raises(ValueError):
        S.add(a, a)
    with pytest.raises(Exception, match="dimensions"):
        S.checked(a, 3).collect()
    left, n = S.delete(a, a.select("chunk_id").union(spark.range(5, 7).toDF("chunk_id")), "x")
    assert n == 1 and left.count() == 0


def test_persist(spark, tmp_path):
    a = S.with_namespace(spark.createDataFrame([(1, [1.0])], "chunk_id long, embedding array<double>"), "n1")
    S.persist(a, str(tmp_path / "t"))
    assert S.load(spark, str(tmp_path / "t")).where("namespace = 'n1'").count() == 1


def test_loaders(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello\nworld")
    (tmp_path / "b.md").write_text("---\ntitle: T: x\nauthor: me\n---\nintro\n# One\n" + "body " * 20 + "\n## Two\nshort\n")
    (tmp_path / "c.html").write_text("<html><head><title> Hi </title><style>p{}</style></head><body><nav>no</nav><p>one</p>\n\n\n\n<p>two</p><script>x</script></body></html>")
    (tmp_path / "d.csv").write_text('k,v\n1,"a, b"\n2,\n')
    (tmp_path / "e.jsonl").write_text('{"t": "x", "m": 1}\n{"t": "y", "m": 2}\n')
    assert L.load(spark, str(tmp_path / "a.txt")).collect()[0].text == "hello\nworld"
    md = L.load_markdown(spark, str(tmp_path / "b.md"), sections=True).collect()
    assert [r.title for r in md] == ["One"] and md[0].extra == {"title": "T: x", "author": "me"}
    html = L.load(spark, str(tmp_path / "c.html")).collect()[0]
    assert html.title == "Hi" and "no" not in html.text.split() and html.text.split()[-2:] == ["one", "two"]
    assert [r.text for r in L.load(spark, str(tmp_path / "d.csv")).orderBy("source").collect()] == ["k: 1 | v: a, b", "k: 2 | v: "]
    js = L.load_json(spark, str(tmp_path / "e.jsonl"), content_key="t", metadata_keys=("m",)).orderBy("text").collect()
    assert [(r.text, r.extra["m"]) for r in js] == [("x", "1"), ("y", "2")]
    with pytest.raises(ValueError):
        L.load(spark, "x.exe")


def test_caches(tmp_path):
    for c in (K.MemoryCache(2), K.DiskCache(tmp_path, 2)):
        c.set("a", 1)
        c.set("b", 2, ttl=0)
        assert c.get("a") == 1 and c.get("b") is None and c.hit_rate == 0.5
        assert c.get_or_set("z", lambda: 5) == 5 and c.delete("z") and not c.delete("z")
    n = []
    f = K.cached(K.MemoryCache())(lambda x, y=1: n.append(x) or x + y)
    assert f(1, y=2) == 3 and f(1, y=2) == 3 and len(n) == 1
    t = K.TieredCache(K.MemoryCache(5), K.MemoryCache(5), promote=2)
    t.set("k", 1)
    assert [t.get("k"), t.get("k"), len(t.fast)] == [1, 1, 1]
    assert K.make_key(1, a=2) != K.make_key(1, a=3)


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("Hello  World", "2024-01-01 00:00:00"), ("hello world", "2024-01-01 00:01:00"), ("other", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "text string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("text string, ts timestamp").parquet(str(src))
    q = streams.deduplicated(stream, "ts").writeStream.format("memory").queryName("unique_docs").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("unique_docs").count() == 2
    q = streams.index_into(stream, str(tmp_path / "out"), str(tmp_path / "cp"), lambda b: b.select("text"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert time.time() > 0


def test_shingles(spark):
    df = spark.createDataFrame([("",), ("ab",), ("abcab",)], "t string")
    assert [r.x for r in df.select(T.char_shingles(F.col("t")).alias("x")).collect()] == [[], ["ab"], ["abc", "bca", "cab"]]
    assert [r.x for r in df.select(T.word_shingles(F.col("t")).alias("x")).collect()] == [[], ["ab"], ["abcab"]]


def test_dense_blocks(spark, monkeypatch):
    r = np.random.default_rng(1)
    v = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(30)], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(25)], "query_id long, vector array<double>")
    whole = sorted(N.dense_top_k(v, q, 3).collect())
    monkeypatch.setattr(N, "against", lambda *a: blocks.against(*a, most=7, most_asked=10))
    small = N.dense_top_k(v, q, 3)
    assert sorted(small.collect()) == whole and len(whole) == 75
    assert len(N.dense_top_k(v, q.limit(0), 3).collect()) == 0
    assert len(N.dense_top_k(v.limit(0), q, 3).collect()) == 0


def test_dense_reads_the_table_once(spark, tmp_path):
    v = spark.range(3000).select(F.col("id").alias("chunk_id"), F.array(F.rand(1), F.rand(2)).alias("embedding"))
    v.write.parquet(f"{tmp_path}/v.parquet")
    v = spark.read.parquet(f"{tmp_path}/v.parquet")
    out = N.dense_top_k(v, v.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector")), 2)  # three blocks of queries
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and "Union" not in plan  # the vectors and the queries
    assert out.count() == 6000 and out.where("rank = 1 and round(score, 5) < 1").count() == 0


def test_bm25_blocks(spark, monkeypatch):
    import random

    r = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    c = spark.createDataFrame([(i, " ".join(r.choices(words, range(40, 0, -1), k=r.randrange(0, 30)))) for i in range(80)], "chunk_id long, content string")
    q = spark.createDataFrame([(i, " ".join(r.choices(words, k=4))) for i in range(20)] + [(20, "none"), (21, None)], "query_id long, query string")
    index = B.Index.build(c)
    every = index.scores(q)
    want = R.top_k(every, 5).collect()
    assert every.count() > len(want)
    monkeypatch.setattr(B, "against", lambda *a, **b: blocks.against(*a, most=9, most_asked=4))
    monkeypatch.setattr(B, "ADDS", 50)
    assert sorted(index.top_k(q, 5).collect()) == sorted(want)


def test_citation_spans_of_all_items_and_whole_texts(spark, tmp_path):
    spark.createDataFrame([(3, "x" * 50), (1002, "see [Source 4] here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {}
    for r in P.citation_spans(spark, str(tmp_path)).collect():
        got.setdefault(r.item_id, []).append(r.asDict())
    assert set(got) == {3, 1002} and len(got[3]) == 2 and len(got[1002]) == 3
    assert min(r["start"] for r in got[3]) == 51


def test_minhash_results_use_all_permutations(spark, tmp_path):
    import hashlib

    from lodestream.plans import text_ops as O

    r = np.random.default_rng(4)
    base = [["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(40)] for _ in range(6)]
    docs = []
    for g, words in enumerate(base):  # shingles of the copies overlap by about 0.8
        for j in range(5):
            docs.append((g * 5 + j, " ".join([f"topic{g}x"] + words[: 40 - j] + ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(j)]), "en", "s"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(g, f"topic{g}x") for g in range(6)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def signature(t, seeds):
        return [min(int(hashlib.md5(i.to_bytes(4, "little") + t[k : k + 3].encode()).hexdigest()[:8], 16) for k in range(len(t) - 2)) for i in range(seeds)]

    ranked = sorted((x.query_id, x["rank"], x.content) for x in O._ranked(spark, str(tmp_path), 5).collect())

    def brute(seeds):
        out, kept = set(), {}
        for q, k, t in ranked:
            s = np.array(signature(t, seeds))
            home = next((h for h, y in kept.setdefault(q, []) if np.mean(s == y) >= 0.8), None)
            if home is None:
                kept[q].append((k, s))
            out.add((q, k, k if home is None else home))
        return out

    got = {(x.query_id, x["rank"], x.kept_as) for x in O.dedup_minhash_results(spark, str(tmp_path)).collect()}
    assert got == brute(128) != brute(32)
