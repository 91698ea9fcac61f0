"""Ranked lists: rows (query_id, chunk_id, score, rank). Scores are rounded before they order rows, ties go to the smaller chunk_id."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACES = 6


def checked_k(k: int) -> int:
    if k <= 0:
        raise ValueError("top_k must be positive")
    return k


def top_k(scored: DataFrame, k: int, by: Sequence[str] = ("query_id",), threshold: float | None = None) -> DataFrame:
    """The k best rows per query with their rank; the threshold applies after the cut, as in the search contract."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "chunk_id")
    out = scored.withColumn("score", F.round("score", PLACES)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= checked_k(k))
    return out if threshold is None else out.where(F.col("score") >= threshold)


def min_max(ranked: DataFrame) -> DataFrame:
    """Scores scaled to 0..1 per query; a single result or equal scores give 1."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return ranked.withColumn("score", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))


def _lists(lists: Sequence[DataFrame]) -> DataFrame:
    each = [x.select("query_id", "chunk_id", "score", "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)]
    return reduce(DataFrame.unionByName, each)


def rrf(lists: Sequence[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank); weights play no part."""
    return _lists(lists).groupBy("query_id", "chunk_id").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"), F.array_sort(F.collect_set("list")).alias("lists"))


def _weight(weights: Sequence[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("list") + 1)


def linear_fusion(lists: Sequence[DataFrame], weights: Sequence[float]) -> DataFrame:
    """Weighted sum of min-max scores per list; a list of equal scores adds 0."""
    if len(lists) != len(weights):
        raise ValueError("one weight per list")
    w = Window.partitionBy("query_id", "list")
    low, high = F.min("score").over(w), F.max("score").over(w)
    part = F.when(high == low, 0.0).otherwise((F.col("score") - low) / (high - low)) * _weight(weights)
    return _lists(lists).withColumn("part", part).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"), F.array_sort(F.collect_set("list")).alias("lists"))


def dbsf(lists: Sequence[DataFrame], weights: Sequence[float]) -> DataFrame:
    """Distribution-based fusion: logistic of the z-score (population deviation, 0 counts as 1), weighted and summed."""
    if len(lists) != len(weights):
        raise ValueError("one weight per list")
    w = Window.partitionBy("query_id", "list")
    sd = F.stddev_pop("score").over(w)
    z = (F.col("score") - F.avg("score").over(w)) / F.when(sd == 0, 1.0).otherwise(sd)
    return _lists(lists).withColumn("part", 1 / (1 + F.exp(-z)) * _weight(weights)).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"), F.array_sort(F.collect_set("list")).alias("lists"))


def linear_rerank(ranked: DataFrame, k: int, query: str = "query", content: str = "content") -> DataFrame:
    """0.6 score + 0.3 share of the query's distinct terms found in the text + 0.1 exact phrase + 0.05 length term."""
    from ..functions.text import split_words

    q, t = F.lower(query), F.lower(content)
    terms = F.array_distinct(split_words(q))
    # the text is lowered once a row, not once a term: an outer lambda binds it
    found = F.get(F.transform(F.array(t), lambda low: F.size(F.filter(terms, lambda x: F.contains(low, x)))), 0)
    share = F.when(F.size(terms) == 0, 0.0).otherwise(found / F.size(terms))
    phrase = F.when(F.contains(t, q), 1.0).otherwise(0.0)
    words = F.size(split_words(F.col(content)))
    length = F.greatest(F.lit(0.0), 1 - 0.001 * F.greatest(F.lit(0), words - 200))
    return top_k(ranked.withColumn("score", 0.6 * F.col("score") + 0.3 * share + 0.1 * phrase + 0.05 * length).withColumnRenamed("rank", "original_rank"), k)
