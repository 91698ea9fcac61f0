"""The segmented index against an index that is built anew, and what its search reads."""

import random

import pytest
from lodestream.operators.bm25 import Index
from lodestream.operators.segments import SegmentedIndex, postings

WORDS = [f"w{i}" for i in range(200)]


def corpus(spark, ids, seed=0):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choices(WORDS, [1 / (j + 1) for j in range(200)], k=r.randrange(0, 60)))) for i in ids]
    return spark.createDataFrame(rows, "chunk_id long, content string").repartition(3)


@pytest.fixture(scope="module")
def asked(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(WORDS, k=r.randrange(1, 7)))) for i in range(25)] + [(98, "w0 w0 w1 w199"), (99, "unknown"), (100, None), (101, "")]
    return spark.createDataFrame(rows, "query_id long, query string")


def same(index, chunks, asked, k):
    want = sorted(Index.build(chunks).top_k(asked, k).collect())
    assert sorted(index.top_k(asked, k).collect()) == want and want


def test_add_remove_merge_equal_a_rebuild(spark, asked, tmp_path):
    c = corpus(spark, range(900)).cache()
    index = SegmentedIndex.create(spark, f"{tmp_path}/i")
    assert index.chunks() is None and index.remove(c.select("chunk_id")) == 0
    assert index.add(c.where("chunk_id % 3 = 0")) == 300
    assert index.add(c.where("chunk_id % 3 <= 1")) == 300  # 300 of them are there
    same(index, c.where("chunk_id % 3 <= 1"), asked, 5)
    assert index.remove(c.select("chunk_id").where("chunk_id % 5 = 0")) == 120
    same(index, c.where("chunk_id % 3 <= 1 and chunk_id % 5 > 0"), asked, 5)
    assert index.add(c.where("chunk_id % 5 = 0")) == 180  # removed chunks come back, and 60 new ones
    now = c.where("chunk_id % 3 <= 1 or chunk_id % 5 = 0")
    for k in (1, 5, 1000):
        same(index, now, asked, k)
    before = index.stats(), sorted(index.terms().collect())
    index.merge()
    assert (index.stats(), sorted(index.terms().collect())) == before and len(index._live()[0]) == 1
    same(index, now, asked, 5)
    index.clear()
    assert index.stats() == (0, 0) and index.top_k(asked, 3).count() == 0
    assert index.add(c) == 900


def test_only_buckets_of_the_terms_are_read(spark, tmp_path):
    index = SegmentedIndex.create(spark, f"{tmp_path}/i")
    index.add(corpus(spark, range(300)))
    q = spark.createDataFrame([(1, "w150")], "query_id long, query string")
    out = index.top_k(q, 3)
    scans = [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan parquet [term#" in x]
    assert scans and all("isnotnull(bucket#" in x.split("PartitionFilters")[1] and "w150" in x.split("PushedFilters")[1] for x in scans), scans


def test_blocks_hold_all_postings(spark):
    c = spark.createDataFrame([(i, 5, ["a", f"b{i % 7}"], [1 + i % 4, 1]) for i in range(1000)], "chunk_id long, len int, terms array<string>, tfs array<int>")
    rows = postings(c).collect()
    assert all(len(r.ids) <= 128 and r.max_tf == max(r.tfs) and r.min_len == 5 for r in rows)
    assert sorted((r.term, i, t) for r in rows for i, t in zip(r.ids, r.tfs)) == sorted((t, i, n) for i in range(1000) for t, n in (("a", 1 + i % 4), (f"b{i % 7}", 1)))


def test_repeated_and_empty_rows(spark, tmp_path):
    index = SegmentedIndex.create(spark, f"{tmp_path}/i")
    c = spark.createDataFrame([(1, "bb x"), (1, "aa x"), (2, None), (3, "")], "chunk_id long, content string")
    assert index.add(c) == 3 and index.stats() == (3, 2)
    q = spark.createDataFrame([(1, "x aa"), (2, "bb")], "query_id long, query string")
    assert [(r.query_id, r.chunk_id) for r in index.top_k(q, 3).collect()] == [(1, 1)]
