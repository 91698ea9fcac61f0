"""A table of chunks with vectors: insert, upsert, delete, namespaces, persistence. Every operation takes and returns a DataFrame, so a
store is whatever table its result is written to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ("namespace", "chunk_id")


def with_namespace(items: DataFrame, namespace: str = "") -> DataFrame:
    return items if "namespace" in items.columns else items.withColumn("namespace", F.lit(namespace))


def checked(items: DataFrame, dimensions: int) -> DataFrame:
    """An error where a vector has another length."""
    ok = F.size("embedding") == dimensions
    return items.withColumn("embedding", F.when(ok, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector has not {dimensions} dimensions")).cast(items.schema["embedding"].dataType)))


def last_of_batch(items: DataFrame, order: str | None = None) -> DataFrame:
    """One row per key; with an order column the last one."""
    if order is None:
        return items.dropDuplicates(list(KEY))
    w = Window.partitionBy(*KEY).orderBy(F.desc(order))
    return items.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def add(store: DataFrame, items: DataFrame) -> DataFrame:
    """The store with the items; ids that the store has, or that come twice, raise."""
    items = with_namespace(items)
    twice = items.groupBy(*KEY).count().where("count > 1").select(*KEY).union(items.join(store, list(KEY), "left_semi").select(*KEY))
    bad = twice.limit(5).collect()
    if bad:
        raise ValueError(f"duplicate ids: {[r.chunk_id for r in bad]}")
    return store.unionByName(items)


def upsert(store: DataFrame, items: DataFrame, order: str | None = None) -> DataFrame:
    new = last_of_batch(with_namespace(items), order)
    if order is not None and order not in store.columns:
        new = new.drop(order)
    return store.join(new, list(KEY), "left_anti").unionByName(new)


def delete(store: DataFrame, ids: DataFrame, namespace: str = "") -> tuple[DataFrame, int]:
    """The store without the ids (chunk_id), and how many rows went."""
    ids = with_namespace(ids, namespace).select(*KEY).distinct()
    return store.join(ids, list(KEY), "left_anti"), store.join(ids, list(KEY), "left_semi").count()


def cleared(store: DataFrame, namespace: str | None = None) -> DataFrame:
    """Without a namespace everything goes."""
    return store.where(F.lit(False)) if namespace is None else store.where(F.col("namespace") != namespace)


def persist(store: DataFrame, path: str) -> None:
    """Parquet by namespace: reading one prunes the others."""
    store.write.mode("overwrite").partitionBy("namespace").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("namespace", F.coalesce(F.col("namespace").cast("string"), F.lit("")))


def in_namespace(store: DataFrame, namespace: str | None = None) -> DataFrame:
    """None: all namespaces."""
    return store if namespace is None else store.where(F.col("namespace") == namespace)


def get(store: DataFrame, ids: DataFrame, namespace: str | None = None) -> DataFrame:
    """The rows of the ids (chunk_id); ids that the store does not have give none."""
    return in_namespace(store, namespace).join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def list_ids(store: DataFrame, namespace: str | None = None) -> DataFrame:
    """(chunk_id), in order; only the id column is read."""
    return in_namespace(store, namespace).select("chunk_id").orderBy("chunk_id")


def count(store: DataFrame, namespace: str | None = None) -> int:
    return in_namespace(store, namespace).count()
