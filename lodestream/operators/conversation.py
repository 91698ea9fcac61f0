"""Dialogue memory over messages (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate

# Phrases of a follow-up.
FOLLOW_UP = (
    "what about", "tell me more", "expand on", "elaborate", "the previous", "that point", "you mentioned", "as you said", "regarding that",
    "more about that", "what else", "continue", "and also", "furthermore", "in addition", "besides that", "going back", "as mentioned",
)


def stats(messages: DataFrame) -> DataFrame:
    """Per conversation: tokens, turns (pairs), last user and last assistant text."""
    is_role = lambda r: F.col("role") == r
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("messages"),
        F.sum(token_estimate(F.col("text"))).alias("total_tokens"),
        F.least(F.count_if(is_role("user")), F.count_if(is_role("assistant"))).alias("turn_count"),
        F.max_by("text", F.when(is_role("user"), F.col("turn"))).alias("last_user"),
        F.max_by("text", F.when(is_role("assistant"), F.col("turn"))).alias("last_assistant"),
    )


def recent(messages: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(n, 0)).drop("_r")


def context(messages: DataFrame, turns: int = 10, keep_system: bool = True) -> DataFrame:
    """System messages first, then the last 2 * turns others: with place, from 1. No turns: none of the others."""
    is_system = (F.col("role") == "system") & F.lit(keep_system)
    late = Window.partitionBy("conv_id", F.col("_system")).orderBy(F.desc("turn"))
    m = messages.withColumn("_system", is_system).withColumn("_r", F.row_number().over(late)).where(F.col("_system") | (F.col("_r") <= 2 * turns))
    order = Window.partitionBy("conv_id").orderBy(F.desc("_system"), "turn")
    return m.withColumn("place", F.row_number().over(order)).drop("_system", "_r")


def compact(messages: DataFrame, max_turns: int = 20, max_tokens: int = 4000) -> DataFrame:
    """What memory keeps: all system messages and the last 2 * max_turns others, without the oldest of these while the sum of tokens is
    above the limit."""
    m = context(messages, max_turns).drop("place").withColumn("_t", token_estimate(F.col("text")))
    by = Window.partitionBy("conv_id")
    system = F.sum(F.when(F.col("role") == "system", F.col("_t")).otherwise(0)).over(by)
    later = F.sum(F.when(F.col("role") == "system", 0).otherwise(F.col("_t"))).over(by.orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0))
    kept = (F.col("role") == "system") | (system + later <= max_tokens)
    return m.withColumn("_keep", kept).where("_keep").drop("_keep", "_t")


def formatted(messages: DataFrame, turns: int = 10) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("place", F.concat(F.upper("role"), F.lit(": "), "text").alias("line"))))  # a bounded context
    return context(messages, turns).groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"))


def is_follow_up(query: Column) -> Column:
    q = F.lower(query)
    return F.exists(F.array(*[F.lit(p) for p in FOLLOW_UP]), lambda p: F.contains(q, p))


def contextualised(messages: DataFrame, queries: DataFrame, window: int = 3) -> DataFrame:
    """queries (conv_id, query) with the last 2 * window messages written above."""
    last = recent(messages.where("role <> 'system'"), 2 * window)
    line = F.when(F.col("role") == "user", F.concat(F.lit("Previous question: "), "text")).when(
        F.col("role") == "assistant", F.concat(F.lit("Previous answer: "), F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text")))
    )
    block = last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("block"))
    q = queries.join(block, "conv_id", "left")
    return q.withColumn("contextualised", F.when(F.col("block").isNull(), F.col("query")).otherwise(F.concat("block", F.lit("\n\nCurrent question: "), "query"))).drop("block")


def standalone(messages: DataFrame, queries: DataFrame) -> DataFrame:
    """Follow-ups with a hint of the last user message, unless they hold it."""
    last = messages.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("last"))
    hint = F.trim(F.substring("last", 1, 60))
    q = queries.join(last, "conv_id", "left")
    add = is_follow_up(F.col("query")) & (hint != "") & ~F.contains(F.lower("query"), F.lower(hint))
    return q.withColumn("standalone", F.when(F.coalesce(add, F.lit(False)), F.concat("query", F.lit(" (in the context of: "), hint, F.lit(")"))).otherwise(F.col("query"))).drop("last")


def by_role(messages: DataFrame, role: str) -> DataFrame:
    return messages.where(F.col("role") == role)


def added(messages: DataFrame, new: DataFrame) -> DataFrame:
    """messages with the new ones (conv_id, place, role, text) behind each conversation's last turn, in order of place."""
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("last"))
    w = Window.partitionBy("conv_id").orderBy("place")
    turn = F.coalesce(F.col("last") + 1, F.lit(0)) + F.row_number().over(w) - 1
    more = new.join(last, "conv_id", "left").withColumn("turn", turn.cast(messages.schema["turn"].dataType))
    return messages.select("conv_id", "turn", "role", "text").unionByName(more.select("conv_id", "turn", "role", "text"))
