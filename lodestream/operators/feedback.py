"""Relevance feedback: events (query, chunk_id, kind, score, ts) and ranks adjusted by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import top_k


def score_of(kind: Column, rating: Column, rank: Column) -> Column:
    """thumbs_up 1, thumbs_down 0, rating its value (an error outside 0..1), click 1 / (1 + rank), 0.5 for a negative rank."""
    bad = F.raise_error(F.lit("a rating must be in 0..1")).cast("double")
    return (
        F.when(kind == "thumbs_up", 1.0)
        .when(kind == "thumbs_down", 0.0)
        .when(kind == "rating", F.when(rating.between(0, 1), rating).otherwise(bad))
        .when(kind == "click", F.when(rank >= 0, 1 / (1 + rank)).otherwise(0.5))
    )


def per_chunk(events: DataFrame) -> DataFrame:
    return events.groupBy("chunk_id").agg(F.avg("score").alias("mean_score"), F.avg((F.col("score") >= 0.5).cast("double")).alias("positive_rate"), F.count("*").alias("events"))


def per_query_chunk(events: DataFrame) -> DataFrame:
    return events.groupBy("query", "chunk_id").agg(F.avg("score").alias("mean_score"), F.count("*").alias("events"))


def adjusted(score: Column, feedback: Column) -> Column:
    return F.when(feedback >= 0.6, F.least(F.lit(1.0), score + 0.2)).when(feedback <= 0.4, F.greatest(F.lit(0.0), score - 0.3)).otherwise(score)


def rerank(ranked: DataFrame, events: DataFrame, k: int = 10) -> DataFrame:
    """ranked (query_id, query, chunk_id, score): the feedback of the query on a chunk counts, else the chunk's from all queries."""
    own = per_query_chunk(events).select("query", "chunk_id", F.col("mean_score").alias("_own"))
    all_ = per_chunk(events).select("chunk_id", F.col("mean_score").alias("_all"))
    j = ranked.join(own, ["query", "chunk_id"], "left").join(all_, "chunk_id", "left")
    return top_k(j.withColumn("score", adjusted(F.col("score"), F.coalesce("_own", "_all"))).drop("_own", "_all", "rank"), k)


def for_chunk(events: DataFrame, chunk_id) -> DataFrame:  # noqa: ANN001
    return events.where(F.col("chunk_id") == chunk_id)


def for_query(events: DataFrame, query: str) -> DataFrame:
    """Events of exactly this query."""
    return events.where(F.col("query") == query)


def for_query_and_chunk(events: DataFrame, query: str, chunk_id) -> DataFrame:  # noqa: ANN001
    return for_chunk(for_query(events, query), chunk_id)


def record(events: DataFrame, path: str) -> None:
    """Appends events to a log of JSON lines; times are ISO 8601."""
    events.write.mode("append").json(path)


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The events of a log. Lines that are no JSON are left out."""
    bad = "_bad"
    rows = spark.read.schema(f"{schema}, {bad} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path)
    return rows.where(F.col(bad).isNull()).drop(bad)
