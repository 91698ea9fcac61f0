"""Retrieval strategies that ask several ways and fuse: every strategy turns queries into sub-queries, retrieves them in one batch and
fuses by reciprocal rank. `retrieve` is any function (queries, k) -> ranked lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import queries as Q
from .ranking import top_k

Retrieve = Callable[[DataFrame, int], DataFrame]
OVERFETCH = 3


def sub_queries(queries: DataFrame, strategy: str, variants: int = 3) -> DataFrame:
    """(query_id, sub, query): the ways of asking, from 0; the query itself among them."""
    q = F.col("query")
    ways: dict[str, Column] = {
        "plain": F.array(q),
        "hyde": F.array(Q.hypothesis(q), q),
        "step_back": F.when(F.lower(Q.step_back(q)) == F.lower(q), F.array(q)).otherwise(F.array(q, Q.step_back(q))),
        "multi_query": F.concat(F.array(q), Q.paraphrases(q, variants)),
    }
    if strategy not in ways:
        raise ValueError(f"no such strategy: {strategy}")
    return queries.select("query_id", F.posexplode(F.array_distinct(ways[strategy])).alias("sub", "query"))


def fused(queries: DataFrame, retrieve: Retrieve, strategy: str, k: int = 10, content: DataFrame | None = None, variants: int = 3) -> DataFrame:
    """(query_id, chunk_id, score, rank). With content (chunk_id, content), results with the text of an earlier one go after the cut."""
    subs = sub_queries(queries, strategy, variants)
    ids = subs.withColumn("sub_id", F.concat_ws("#", F.col("query_id").cast("string"), F.col("sub").cast("string")))
    got = retrieve(ids.select(F.col("sub_id").alias("query_id"), "query"), k * OVERFETCH)
    each = got.join(ids.select(F.col("sub_id"), F.col("query_id").alias("_q")), got["query_id"] == F.col("sub_id")).select(F.col("_q").alias("query_id"), "chunk_id", "rank")
    best = top_k(each.groupBy("query_id", "chunk_id").agg(F.sum(1 / (F.lit(60) + F.col("rank"))).alias("score")), k)
    return best if content is None else without_repeats(best, content)


def without_repeats(ranked: DataFrame, content: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id", "_h").orderBy("rank")
    with_hash = ranked.join(content.select("chunk_id", F.md5("content").alias("_h")), "chunk_id")
    return with_hash.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*ranked.columns)


def composite(queries: DataFrame, retrieve: Retrieve, strategies: tuple[str, ...] = ("multi_query", "step_back"), k: int = 10) -> DataFrame:
    """Reciprocal rank fusion over strategies, each asked for three times as many."""
    from .ranking import rrf

    return top_k(rrf([fused(queries, retrieve, s, k * OVERFETCH) for s in strategies]).drop("lists"), k)


def routed(queries: DataFrame, retrieve: Retrieve, k: int = 10) -> DataFrame:
    """Every query by the strategy of its intent; the slices are united again."""
    q = Q.classified(queries)
    part = lambda *intents: q.where(F.col("intent").isin(*intents)).select("query_id", "query")
    out = fused(part("factual", "definitional"), retrieve, "hyde", k)
    out = out.unionByName(fused(part("procedural"), retrieve, "step_back", k))
    out = out.unionByName(fused(part("comparative"), retrieve, "multi_query", k, variants=4))
    out = out.unionByName(fused(part("unknown"), retrieve, "multi_query", k))
    out = out.unionByName(composite(part("multi_hop"), retrieve, k=k))
    return out.join(q.select("query_id", "intent", "confidence", "strategy"), "query_id")
