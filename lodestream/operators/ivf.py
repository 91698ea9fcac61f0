"""A vector index of cells: a coarse quantiser, vectors stored by cell, and top-k over the nearest cells.

The quantiser is k-means (Spark ML) over a bounded sample, `sample` rows of smallest id hash; every vector is stored, in the folder of
the cell whose centroid is nearest. A query looks into the `nprobe` cells nearest to it: only their folders are read. With nprobe = cells
the result is the exact one. `tuned` doubles nprobe until a stated share of the exact results of a sample of queries is found.

Vectors that are null have no cell and are nowhere; those of another length raise. Filters are applied where the cells are read. The
centroids, `cells` times the dimensions, are told to all tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import against
from .dense import MetadataFilter, best_of, block_scores, dense_top_k, filtered, matrix
from .ranking import PLACES, checked_k, top_k
from .tables import shared_dir

SAMPLE = 1 << 16  # vectors that the quantiser is fitted on


def train(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """The centroids, a row each: no more than `cells`, fewer where the sample has fewer distinct vectors."""
    known = vectors.where("embedding is not null")
    fit = known.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=max(2, cells), maxIter=rounds, seed=seed).fit(fit)
    return np.array(model.clusterCenters())


def nearest_cells(v: np.ndarray, centroids: np.ndarray, n: int, metric: str) -> np.ndarray:
    """The n best cells of each row of v, best first."""
    s = block_scores(v, centroids, metric if metric != "euclidean" else "dot")
    if metric == "euclidean":  # of equal order as the distance
        s = 2 * s - (centroids**2).sum(axis=1)
    return np.argsort(-s, axis=1, kind="stable")[:, :n]


def with_cells(df: DataFrame, column: str, centroids: np.ndarray, n: int, metric: str) -> DataFrame:
    """df with cell: a row for each of the n best cells of its vector; null vectors go."""
    told = df.sparkSession.sparkContext.broadcast(centroids)
    names = df.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cells = nearest_cells(matrix(pa.chunked_array([b.column(names.index(column))]), told.value.shape[1]), told.value, n, metric)
                out = b.take(pa.array(np.repeat(np.arange(b.num_rows), cells.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(cells.reshape(-1).astype(np.int32)), *out.columns], ["cell", *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.where(F.col(column).isNotNull()).mapInArrow(deal, f"cell int, {kinds}")


@dataclass(frozen=True)
class IVFIndex:
    spark: SparkSession
    path: str
    centroids: np.ndarray
    metric: str
    nprobe: int

    @classmethod
    def build(cls, vectors: DataFrame, *, cells: int = 100, nprobe: int = 10, metric: str = "cosine", sample: int = SAMPLE, path: str | None = None) -> IVFIndex:
        """vectors (chunk_id, embedding, ...): all columns are stored."""
        spark = vectors.sparkSession
        path = path or f"{shared_dir(spark)}/lodestream/ivf-{uuid.uuid4().hex}"
        centroids = train(vectors, cells, sample)
        rows = [(i, c.tolist(), metric) for i, c in enumerate(centroids)]
        spark.createDataFrame(rows, "cell int, centroid array<double>, metric string").coalesce(1).write.parquet(f"{path}/centroids")
        out = cls(spark, path, centroids, metric, min(nprobe, len(centroids)))
        out.add(vectors)
        return out

    @classmethod
    def load(cls, spark: SparkSession, path: str, nprobe: int = 10) -> IVFIndex:
        rows = sorted(spark.read.parquet(f"{path}/centroids").collect())  # a row a cell
        return cls(spark, path, np.array([r.centroid for r in rows]), rows[0].metric, min(nprobe, len(rows)))

    def add(self, vectors: DataFrame) -> None:
        """Stores more vectors in the cells; the quantiser stays as it is."""
        dealt = with_cells(vectors, "embedding", self.centroids, 1, self.metric)
        dealt.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{self.path}/vectors")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def rebuilt(self, cells: int, path: str | None = None) -> IVFIndex:
        """An index of the stored vectors with a quantiser fitted anew."""
        return IVFIndex.build(self.rows().drop("cell"), cells=cells, nprobe=self.nprobe, metric=self.metric, path=path)

    def top_k(self, queries: DataFrame, k: int = 10, *, nprobe: int | None = None, filters: Sequence[MetadataFilter] = (), threshold: float | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank) of queries (query_id, vector)."""
        checked_k(k)
        metric = self.metric
        asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        asked = with_cells(asked, "vector", self.centroids, nprobe or self.nprobe, self.metric)
        wanted = [r.cell for r in asked.select("cell").distinct().collect()]  # no more than there are cells
        rows = filtered(self.rows().where(F.col("cell").isin(wanted)), filters).select("cell", "chunk_id", F.col("embedding").cast("array<double>"))

        def scored(mine: pa.Table, theirs: pa.Table) -> Iterator[pa.RecordBatch]:
            q = matrix(theirs.column(2))
            s = np.round(block_scores(matrix(mine.column(2), q.shape[1]), q, metric), PLACES)
            place = np.argsort(np.argsort(mine.column(1).to_numpy(), kind="stable"), kind="stable")
            row, of = best_of(s, place, k)
            yield from pa.table([theirs.column(1).take(pa.array(of)), mine.column(1).take(pa.array(row)), pa.array(s[row, of])], ["query_id", "chunk_id", "score"]).to_batches()

        kinds = {"query_id": queries.schema["query_id"].dataType, "chunk_id": rows.schema["chunk_id"].dataType}
        schema = ", ".join(f"{c} {t.simpleString()}" for c, t in kinds.items()) + ", score double"
        most = 4096 if metric != "euclidean" else 512
        return top_k(against(rows, asked, scored, schema, most=most, most_asked=256, key="cell"), k, threshold=threshold)

    def tuned(self, queries: DataFrame, k: int = 10, target: float = 0.9, most: int = 1000) -> IVFIndex:
        """The index with the smallest doubled nprobe that finds `target` of the exact results of up to `most` queries."""
        some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(most)
        exact = dense_top_k(self.rows(), some, k, metric=self.metric).cache()
        nprobe = self.nprobe
        while nprobe < len(self.centroids) and recall(self.top_k(some, k, nprobe=nprobe), exact).agg(F.avg("recall")).first()[0] < target:
            nprobe = min(2 * nprobe, len(self.centroids))
        exact.unpersist()
        return replace(self, nprobe=nprobe)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, relevant, found, recall) for every query of `exact`."""
    hit = found.select("query_id", "chunk_id", F.lit(1).alias("hit"))
    t = exact.join(hit, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count("*").alias("relevant"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"))
    return t.withColumn("recall", F.col("found") / F.col("relevant"))
