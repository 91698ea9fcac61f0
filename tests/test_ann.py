"""Approximate vector search against the exact scan."""

import numpy as np
import pytest
from lodestream.operators.dense import MetadataFilter, dense_top_k
from lodestream.operators.ivf import IVFIndex, recall
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 12))
    rows = [(i, (centres[i % 20] + 0.5 * r.normal(size=12)).tolist(), i % 5) for i in range(1500)] + [(9998, None, 1), (9999, [0.0] * 12, 1)]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<double>, label int").repartition(4).cache()


@pytest.fixture(scope="module")
def queries(vectors):
    return vectors.where("chunk_id % 50 = 3").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector")).cache()


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_all_cells_are_exact_and_few_find_most(vectors, queries, metric):
    index = IVFIndex.build(vectors, cells=20, nprobe=1, metric=metric)
    exact = dense_top_k(vectors, queries, 10, metric=metric).cache()
    assert sorted(index.top_k(queries, 10, nprobe=20).collect()) == sorted(exact.collect())
    tuned = index.tuned(queries, 10, 0.9)
    assert tuned.nprobe <= 16 and recall(tuned.top_k(queries, 10), exact).agg(F.avg("recall")).first()[0] >= 0.9


def test_reads_the_cells_of_the_query_and_filters(spark, vectors, queries, tmp_path):
    index = IVFIndex.build(vectors, cells=20, nprobe=2, path=f"{tmp_path}/i")
    again = IVFIndex.load(spark, f"{tmp_path}/i", nprobe=2)
    one = queries.limit(1)
    plan = again.top_k(one, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("cell#") and "PartitionFilters: [cell#" in plan.replace("isnotnull(cell", "cell")
    f = [MetadataFilter("label", "gt", 2)]
    assert sorted(again.top_k(queries, 5, nprobe=20, filters=f).collect()) == sorted(dense_top_k(vectors, queries, 5, filters=f).collect())
    more = vectors.where("chunk_id < 10").withColumn("chunk_id", F.col("chunk_id") + 100_000)
    again.add(more)
    assert sorted(again.top_k(queries, 5, nprobe=20).collect()) == sorted(dense_top_k(vectors.union(more), queries, 5).collect())
    assert again.rebuilt(5).rows().count() == vectors.count() - 1 + 10
    assert index.top_k(queries.limit(0), 5).count() == 0
