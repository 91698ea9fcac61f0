"""Model calls, plugins, metrics, stored graphs and feedback, store reads."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestream.operators import bm25 as B
from lodestream.operators import feedback as FB
from lodestream.operators import generation as G
from lodestream.operators import models as M
from lodestream.operators import store as S
from lodestream.plans import pipeline as P
from lodestream.sources import loaders as L


def test_one_bad_row_costs_no_other_its_value(spark):
    def f(part):
        if "bad" in set(part.prompt):
            raise M.ModelError("no", retryable=False)
        return [x.upper() for x in part.prompt]

    df = spark.createDataFrame([(i, "bad" if i == 3 else f"p{i}") for i in range(10)], "query_id int, prompt string")
    got = {r.query_id: r for r in M.answered(df, f, batch=4, delay=0).collect()}
    assert len(got) == 10 and got[3].answer is None and got[3].error == "ModelError: no"
    assert all(got[i].answer == f"P{i}" and got[i].error is None for i in range(10) if i != 3)
    with pytest.raises(ValueError):
        M.answered(df.withColumn("error", F.lit(1)), f)


def test_retries_and_wrong_counts(spark):
    def flaky(part):
        flaky.n += 1
        if flaky.n % 2:
            raise ConnectionError("again")
        return [[1.0, 2.0]] * len(part)

    flaky.n = 0
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "content string").coalesce(1)
    assert [(r.content, list(r.embedding), r.error) for r in M.embedded(df, flaky, delay=0).orderBy("content").collect()] == [(x, [1.0, 2.0], None) for x in "aab"]
    short = M.called(df, lambda part: [], ["content"], "x", "int", delay=0).collect()
    assert all(r.x is None and "0 values" in r.error for r in short)


def test_model_reranking(spark):
    df = spark.createDataFrame([(1, i, 1.0, i + 1, "q", c) for i, c in enumerate(["a", "bbb", "cc"])], "query_id int, chunk_id int, score double, rank int, query string, content string")
    got = M.reranked(df, lambda part: [float(len(x)) for x in part.content], 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.original_rank, r["rank"]) for r in got] == [(1, 2, 1), (2, 3, 2)]


def test_plugins_and_metrics(tmp_path, spark, caplog):
    (tmp_path / "one.py").write_text("class A:\n    def before_query(self, **k): pass\ndef plugins():\n    return {'a': A()}\n")
    h = P.Hooks()
    assert h.load_directory(tmp_path) == ["a"]
    counting = P.CountingPlugin()
    h.register("count", counting, "metrics")
    h.register("log", P.LoggingPlugin())
    assert [d["hooks"] for d in h.describe() if d["name"] == "a"] == [["before_query"]]
    pipe = P.Pipeline(P.PipelineConfig(), hooks=h)
    with pytest.raises(ValueError):
        pipe.query(spark.createDataFrame([(1, "x")], "query_id int, query string"))
    assert counting.counts["before_query"] == 1 and counting.counts["on_error"] == 1 and "query failed" in caplog.text
    m = P.Metrics()
    f = m.instrument("job")(lambda x: 1 / x)
    f(1)
    with pytest.raises(ZeroDivisionError):
        f(0)
    assert m.snapshot()["counts"] == {"job.calls": 2, "job.failed": 1} and m.snapshot()["mean_ms"]["job"] >= 0


def test_feedback_log_leaves_broken_lines_out(spark, tmp_path):
    path = str(tmp_path / "log")
    FB.record(spark.createDataFrame([("q", 1, 0.5)], "query string, chunk_id long, score double"), path)
    with open(tmp_path / "log" / "broken.json", "w") as f:
        f.write('{"query": "q", "chunk\n')
    assert [tuple(r) for r in FB.load(spark, path, "query string, chunk_id long, score double").collect()] == [("q", 1, 0.5)]


def test_store_reads(spark):
    s = spark.createDataFrame([("a", 1, [1.0]), ("a", 2, [2.0]), ("b", 1, [3.0])], "namespace string, chunk_id long, embedding array<double>")
    ids = spark.createDataFrame([(1,), (9,), (1,)], "chunk_id long")
    assert S.get(s, ids).count() == 2 and S.get(s, ids, "b").count() == 1
    assert [r.chunk_id for r in S.list_ids(s, "a").collect()] == [1, 2] and S.count(s) == 3 and S.count(s, "c") == 0


def test_responses(spark):
    df = spark.createDataFrame([(1, "hello big world"), (2, "")], "k int, answer string")
    r = {x.k: x for x in G.to_response(G.stream(df, 4), "k", "m").collect()}
    assert r[1].text == "hello big world" and r[1].finish_reason == "stop" and r[1].completion_tokens == 3 and r[2].text == ""
    cut = G.to_response(G.stream(df, 4).where("not is_final"), "k").collect()
    assert all(x.finish_reason is None for x in cut)
    x = spark.range(1).select(G.is_truncated(F.lit("length")).alias("t"), G.is_complete(F.lit(None).cast("string")).alias("c"), G.source_label(F.lit(3)).alias("s")).collect()[0]
    assert x.t and not x.c and x.s == "[Source 3]"


def test_index_of_odd_texts(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "the of and"), (4, "moon moon sun"), (5, "Sun, sun; moon!"), (6, "moon moon sun")]
    i = B.Index.build(spark.createDataFrame(rows, "chunk_id int, content string"), str(tmp_path / "i"))
    assert {r.chunk_id: (r.len, dict(zip(r.terms, r.tfs))) for r in i.chunks.collect()} == {1: (0, {}), 2: (0, {}), 3: (0, {}), 4: (3, {"moon": 2, "sun": 1}), 5: (3, {"moon": 1, "sun": 2}), 6: (3, {"moon": 2, "sun": 1})}
    again = B.Index.load(spark, str(tmp_path / "i"))
    q = spark.createDataFrame([("a", "moon"), ("b", "nothing"), ("c", None)], "query_id string, query string")
    assert [(r.query_id, r.chunk_id) for r in again.top_k(q, 2).orderBy("rank").collect()] == [("a", 4), ("a", 6)]
    left = again.without(spark.createDataFrame([(4,)], "chunk_id int"))
    assert {r.term: r.df for r in left.terms.collect()} == {"moon": 2, "sun": 2} and left.stats().collect()[0].n == 5
    assert pd.isna(B.Index.build(spark.createDataFrame([], "chunk_id int, content string")).stats().toPandas().avgdl[0])


def test_ids_of_records_do_not_follow_the_partitions(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.csv").write_text("x,y\n" + "".join(f"{i},{name}\n" for i in range(50)) + "7,same\n7,same\n")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    found = []
    for cost in ("1", "1g"):  # files packed together, or each by itself
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
        found.append(sorted((r.doc_id, r.text) for r in L.load_csv(spark, str(tmp_path)).collect()))
    spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert found[0] == found[1] and len({i for i, _ in found[0]}) == 156
