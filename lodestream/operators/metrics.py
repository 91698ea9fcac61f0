"""Telemetry as aggregates over event rows: counters, gauges, histograms, costs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Prices in USD per 1000 tokens, prompt and completion.
PRICES = {
    "gpt-4o": (0.005, 0.015), "gpt-4o-mini": (0.00015, 0.0006), "gpt-4-turbo": (0.01, 0.03), "gpt-4": (0.03, 0.06), "gpt-3.5-turbo": (0.001, 0.002),
    "claude-3-5-sonnet-20241022": (0.003, 0.015), "claude-3-5-haiku-20241022": (0.0008, 0.004), "claude-3-opus-20240229": (0.015, 0.075),
    "gemini-1.5-pro": (0.00125, 0.005), "gemini-1.5-flash": (0.000075, 0.0003),
    "text-embedding-3-small": (0.00002, 0.0), "text-embedding-3-large": (0.00013, 0.0), "text-embedding-ada-002": (0.0001, 0.0),
}


def counters(points: DataFrame, *labels: str) -> DataFrame:
    return points.groupBy("name", *labels).agg(F.sum("value").alias("total"))


def gauges(points: DataFrame, *labels: str, order: str = "ts") -> DataFrame:
    return points.groupBy("name", *labels).agg(F.max_by("value", order).alias("last"))


def histograms(points: DataFrame, *labels: str) -> DataFrame:
    """count, total, min, max, mean and the 50th, 95th, 99th percentile as the value at place floor(n * p / 100) of the sorted values.
    The places come from distributed ranks, so no group is collected."""
    from pyspark.sql import Window

    keys = ["name", *labels]
    stats = points.groupBy(*keys).agg(F.count("value").alias("count"), F.sum("value").alias("total"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))
    by_value = points.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count("*").alias("c"))
    cum = F.sum("c").over(Window.partitionBy(*keys).orderBy("value"))
    r = by_value.withColumn("upto", cum).join(stats.select(*keys, "count"), keys)
    at = lambda p: F.least(F.floor(F.col("count") * p / 100), F.col("count") - 1)
    pick = lambda p: F.min(F.when(F.col("upto") > at(p), F.col("value"))).alias(f"p{p}")
    return stats.join(r.groupBy(*keys).agg(pick(50), pick(95), pick(99)), keys)


def with_cost(usage: DataFrame, prices: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """usage (model, prompt_tokens, completion_tokens) with cost; a model without a price costs nothing."""
    table = PRICES if prices is None else prices
    p = usage.sparkSession.createDataFrame([(m, a, b) for m, (a, b) in table.items()], "model string, _in double, _out double")
    cost = F.coalesce(F.col("prompt_tokens") / 1000 * F.col("_in") + F.col("completion_tokens") / 1000 * F.col("_out"), F.lit(0.0))
    return usage.join(F.broadcast(p), "model", "left").withColumn("cost", cost).drop("_in", "_out")


def cost_report(usage: DataFrame) -> DataFrame:
    """Calls, tokens and cost per model, and in all (model null)."""
    return with_cost(usage).rollup("model").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("cost").alias("cost"))


def batch_report(results: DataFrame) -> DataFrame:
    """results (error, latency_ms): queries, failures, success rate (0 for none), mean latency."""
    return results.agg(F.count("*").alias("queries"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.coalesce(F.avg(F.col("error").isNull().cast("double")), F.lit(0.0)).alias("success_rate"), F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"))
