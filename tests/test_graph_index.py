import random

from lodestream.operators import graph as G
from lodestream.operators.graph_index import GraphIndex, closed
from pyspark.sql import functions as F

DOCS = [(i, random.Random(i).choice(["FAISS uses vector search. Redis is part of docker.", "GPUs run bert and pytorch. Git extends docker!", "nothing here", "RAG and redis are related. 12 layers"])) for i in range(40)]


def whole(spark, docs):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    m = G.mentions(d)
    ent = {(r.key, r.type, len(r.doc_ids)) for r in G.entities(m).collect()}
    rel = {(r.subject, r.predicate, r.obj, r.weight, len(r.doc_ids)) for r in G.relations(G.stated_relations(d, m)).collect()}
    return ent, rel


def views(g):
    return {(r.key, r.type, r.documents) for r in g.entities().collect()}, {tuple(r) for r in g.relations().collect()}


def test_batches_in_any_split_equal_one(spark, tmp_path):
    g = GraphIndex(spark, f"{tmp_path}/g")
    d = spark.createDataFrame(DOCS, "doc_id long, text string")
    g.index(d.where("doc_id % 3 = 0"), 0)
    g.index(d.where("doc_id % 3 = 1"), 1)
    g.index(d.where("doc_id % 3 = 1"), 1)  # a replay
    g.index(d.where("doc_id % 3 = 2"), 2)
    want = whole(spark, DOCS)
    assert views(g) == want and len(want[0]) > 5 and len(want[1]) > 5
    g.index(spark.createDataFrame([(0, "FAISS uses docker")], d.schema), 3)  # a document anew
    assert views(g) == whole(spark, [(0, "FAISS uses docker"), *DOCS[1:]])


def test_stream_equals_one_batch(spark, tmp_path):
    d = spark.createDataFrame(DOCS, "doc_id long, text string")
    d.repartition(3).write.parquet(f"{tmp_path}/in")
    g = GraphIndex(spark, f"{tmp_path}/g")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    g.index_stream(stream, f"{tmp_path}/cp").awaitTermination()
    assert views(g) == whole(spark, DOCS)


def test_aliases(spark, tmp_path):
    g = GraphIndex(spark, f"{tmp_path}/g")
    g.index(spark.createDataFrame([(1, "FAISS uses redis"), (2, "Redis")], "doc_id long, text string"), 0)
    g.add_aliases(spark.createDataFrame([("Facebook Search", "faiss"), ("fs", " facebook search "), ("x", "y"), ("redis", "faiss"), ("remote dict", "Redis")], "alias string, name string"), 0)
    names = spark.createDataFrame([("FAISS ",), ("FS",), ("Remote Dict",), ("redis",), ("x",), ("y",)], "name string")
    got = {r.asked: (r.key, r.documents) for r in g.lookup(names).collect()}
    assert got == {"FAISS ": ("faiss", 1), "redis": ("redis", 2), "FS": ("faiss", 1), "Remote Dict": ("faiss", 1)}  # one group: the smallest key
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(50)], "alias string, name string")
    assert {r.root for r in closed(chain).collect()} == {"n000"}
    assert closed(chain.limit(0)).select(F.count("*")).first()[0] == 0
