import pytest

from lodestream.operators.dense import MetadataFilter
from lodestream.plans import pipeline as P

DOCS = [(1, "Cats chase mice. Mice eat cheese in the old barn."), (2, "Dogs guard the house at night."), (3, "Cheese is made of milk.")]


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.mark.parametrize("method", ["bm25", "vector", "hybrid"])
def test_ingest_and_query(spark, method):
    pipe = P.PipelineBuilder().chunk("fixed", 60, 0).embed(16).retrieve(method, top_k=2).build()
    seen = []
    pipe.events.subscribe(lambda name, data: seen.append(name))
    pipe.ingest(docs(spark))
    q = spark.createDataFrame([("a", "dogs house night")], "query_id string, query string")
    hits = pipe.retrieve(q).orderBy("rank").collect()
    assert [r["rank"] for r in hits] == list(range(1, len(hits) + 1)) and len(hits) <= 2
    if method == "bm25":
        assert hits[0].document_id == 2
    row = pipe.query(q).collect()[0]
    assert "Question: dogs house night" in row.prompt and row.answer.startswith("This is a mock response") and row.usage.total_tokens > 0 and len(row.sources) == len(hits)
    assert seen == ["ingested", "answered"]
    pipe.ingest(docs(spark).where("doc_id = 2"))
    assert pipe.stats()["documents"] == 3
    pipe.delete_document(2)
    assert pipe.stats()["documents"] == 2
    assert all(r.document_id == 3 for r in pipe.retrieve(q, filters=(MetadataFilter("document_id", "gt", 1),)).collect())


def test_configuration(tmp_path):
    c = P.PRESETS["qa"]
    c.save(tmp_path / "c.json")
    assert P.load_config(tmp_path / "c.json") == c
    with pytest.raises(ValueError):
        P.config_from({"nothing": 1})
    assert len(P.PipelineBuilder().chunk("none", 10, 20).validate()) == 2
    with pytest.raises(ValueError):
        P.PipelineBuilder().retrieve("guess").build()


def test_registry_events_hooks_tracer():
    r = P.Registry()
    r.register("chunker", "x", lambda n=1: n)
    with pytest.raises(ValueError):
        r.register("chunker", "x", lambda: 2)
    assert r.build("chunker", "x", n=5) == 5 and r.all()["chunker"] == ["x"]
    e, got = P.Events(), []
    h = lambda n, d: got.append(n)
    e.subscribe(h, "a")
    e.subscribe(lambda n, d: 1 / 0)
    e.emit("a")
    e.emit("b")
    assert got == ["a"] and e.unsubscribe(h) == 1
    hooks = P.Hooks()
    hooks.register("p", type("X", (), {"before_query": lambda self, **k: got.append("hook")})(), "t")
    hooks.call("before_query", queries=None)
    assert got[-1] == "hook" and hooks.by_tag("t") == ["p"]
    t = P.Tracer(1)
    with pytest.raises(ZeroDivisionError), t.span("outer") as s, t.span("inner", s):
        1 / 0
    assert len(t.spans) == 1 and t.spans[0]["status"] == "error"
    assert [P.TokenBucket(1, 2, wait=False).take() for _ in range(1)] == [True]
    n = []
    assert P.with_retry(lambda: n.append(1) or (len(n) > 1 or 1 / 0), delay=0) and len(n) == 2
