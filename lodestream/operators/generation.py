"""Prompts, deterministic answers, citations and token streams as columns."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_words

MARKER = r"(?i)\[source\s+(\d+)\]"
PLACEHOLDER = re.compile(r"\{(\w+)\}")


def undeclared(template: str, variables: set[str]) -> list[str]:
    return sorted(set(PLACEHOLDER.findall(template)) - variables)


def rendered(template: str, values: Mapping[str, Column], defaults: Mapping[str, str] | None = None) -> Column:
    """The template with its {names} filled; a name with neither value nor default raises."""
    defaults = defaults or {}
    missing = undeclared(template, {*values, *defaults})
    if missing:
        raise ValueError(f"no value for {', '.join(missing)}")
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else values.get(p, F.lit(defaults.get(p, ""))) for i, p in enumerate(parts)])


def context_block(ranked: DataFrame, budget: int = 8000) -> DataFrame:
    """(query_id, context): numbered passages in rank order within the budget; one that no longer fits is cut if more than 100
    characters are left."""
    label = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("]"))
    passage = F.trim("content")
    entry = F.concat(label, F.lit("\n"), passage)
    w = Window.partitionBy("query_id").orderBy("rank")
    t = ranked.select("query_id", "rank", label.alias("label"), passage.alias("passage"), entry.alias("entry"))
    t = t.withColumn("before", F.coalesce(F.sum(F.length("entry") + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("fits", F.col("before") + F.length("entry") <= budget)
    t = t.withColumn("cut", F.coalesce(F.sum((~F.col("fits")).cast("int")).over(w), F.lit(0)))  # 1: the first that does not fit
    room = F.lit(budget) - F.col("before")
    short = F.concat("label", F.lit("\n"), F.substr(F.col("passage"), F.lit(1), (room - F.length("label") - 5).cast("int")), F.lit("..."))
    t = t.withColumn("line", F.when(F.col("fits") & (F.col("cut") == 0), F.col("entry")).when((F.col("cut") == 1) & ~F.col("fits") & (room > 100), short))
    lines = F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("rank", "line"))))  # within the budget
    return t.groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("context"))


def mock_answer(query: Column) -> Column:
    """The deterministic answer; the query is quoted as Python would quote it (without escapes of control characters)."""
    single = F.contains(query, F.lit("'")) & ~F.contains(query, F.lit('"'))
    slashed = F.replace(query, F.lit("\\"), F.lit("\\\\"))
    slashed = F.replace(F.replace(F.replace(slashed, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r"))
    quoted = F.when(single, F.concat(F.lit('"'), slashed, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(slashed, F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.concat(F.lit("This is a mock response to: "), quoted, F.lit(". No real LLM was called; this text is generated deterministically by MockLLM for testing purposes."))


def usage(prompt: Column, answer: Column) -> Column:
    p, c = F.size(split_words(prompt)), F.size(split_words(answer))
    return F.struct(p.alias("prompt_tokens"), c.alias("completion_tokens"), (p + c).alias("total_tokens"))


def stream(answers: DataFrame, size: int = 5, answer: str = "answer") -> DataFrame:
    """One row per slice of the answer: place, delta, is_final; an empty answer gives one final row."""
    parts = F.expr(f"transform(sequence(1, greatest(length({answer}), 1), {max(size, 1)}), i -> substring({answer}, i, {max(size, 1)}))")
    s = answers.withColumn("_p", parts)
    return s.select(*answers.columns, F.size("_p").alias("_n"), F.posexplode("_p").alias("place", "delta")).withColumn("is_final", F.col("place") + 1 == F.col("_n")).drop("_n")


def collected(stream_rows: DataFrame, key: str) -> DataFrame:
    """The deltas put together again, in order of place."""
    return stream_rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "delta"))), lambda x: x["delta"]), "").alias("text"), F.count("*").alias("chunks"))


def markers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(MARKER), F.lit(1)), lambda n: n.cast("int"))


def marker_spans(text: Column) -> Column:
    """(number, start, end) of every marker, in order: what stands between markers gives the places."""
    between = F.transform(F.split(text, MARKER), F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(MARKER), F.lit(0)), F.length)
    nums = markers(text)
    start = lambda i: F.aggregate(F.slice(between, 1, i + 1), F.lit(0), lambda a, x: a + x) + F.aggregate(F.slice(whole, 1, i), F.lit(0), lambda a, x: a + x)
    return F.transform(nums, lambda n, i: F.struct(n.alias("number"), start(i).alias("start"), (start(i) + F.get(whole, i)).alias("end")))


def stripped(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, MARKER, ""), r"[ \t]{2,}", " "))


def cited(answers: DataFrame, answer: str = "answer", sources: str = "n_sources") -> DataFrame:
    """cited, unknown and uncited source numbers (sorted, distinct) and the answer without markers."""
    m = F.array_sort(F.array_distinct(markers(F.col(answer))))
    known = lambda x: (x >= 1) & (x <= F.col(sources))
    given = F.when(F.col(sources) > 0, F.sequence(F.lit(1), F.col(sources).cast("int"))).otherwise(F.array().cast("array<int>"))
    return answers.withColumn("cited", F.filter(m, known)).withColumn("unknown", F.filter(m, lambda x: ~known(x))).withColumn("uncited", F.array_except(given, m)).withColumn("clean_text", stripped(F.col(answer)))


def preview(content: Column, n: int = 120) -> Column:
    t = F.trim(content)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def bibliography(citations: DataFrame) -> DataFrame:
    """(query_id, source_number, document_id, content): a numbered list per query."""
    line = F.concat(F.lit("["), F.col("source_number").cast("string"), F.lit("] "), F.col("document_id").cast("string"), F.lit('\n  "'), preview(F.col("content")), F.lit('"'))
    return citations.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_number", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("bibliography"))


def is_complete(finish_reason: Column) -> Column:
    return F.coalesce(finish_reason == "stop", F.lit(False))


def is_truncated(finish_reason: Column) -> Column:
    return F.coalesce(finish_reason == "length", F.lit(False))


def source_label(number: Column) -> Column:
    return F.format_string("[Source %d]", number)


def to_response(stream_rows: DataFrame, key: str, model: str = "") -> DataFrame:
    """(key, text, chunks, finish_reason, model): stop once the final delta is there, else null; usage counts words of the text."""
    done = stream_rows.groupBy(key).agg(F.max("is_final").alias("done"))
    r = collected(stream_rows, key).join(done, key)
    return r.select(key, "text", "chunks", F.when(F.col("done"), "stop").alias("finish_reason"), F.lit(model).alias("model"), F.size(split_words(F.col("text"))).alias("completion_tokens"))
