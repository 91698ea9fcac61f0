"""What happens to results before they become a prompt: adaptive depth, compression, explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import KEYWORD_STOP, keywords, letter_words, sentences_before_capital


def adaptive(ranked: DataFrame, queries: DataFrame, *, initial: int = 3, factor: float = 2.0, most: int = 20, coverage: float = 0.6, spread: float = 0.01, content: str = "content") -> DataFrame:
    """ranked must hold the `most` best per query (any prefix-stable retriever). Per query the smallest depth of initial, initial * factor,
    ... whose prefix covers enough query keywords, or has scores too close to go on, or is the last: final_k, coverage, spread, reason."""
    steps, k = [], initial
    while True:
        steps.append(k)
        if k >= most:
            break
        k = min(int(k * factor), most)
    q = queries.select("query_id", keywords(F.col("query")).alias("kw"))
    hits = ranked.where(F.col("rank") <= most).join(q, "query_id").select("query_id", "rank", "score", F.array_intersect("kw", F.array_distinct(letter_words(F.col(content)))).alias("terms"))
    agg = [x for n, s in enumerate(steps) for x in (F.array_distinct(F.flatten(F.collect_list(F.when(F.col("rank") <= s, F.col("terms"))))).alias(f"t{n}"), F.max(F.when(F.col("rank") <= s, F.col("score"))).alias(f"h{n}"), F.min(F.when(F.col("rank") <= s, F.col("score"))).alias(f"l{n}"), F.count_if(F.col("rank") <= s).alias(f"n{n}"))]
    t = q.join(hits.groupBy("query_id").agg(*agg), "query_id", "left")
    tried = []
    for n, s in enumerate(steps):
        cov = F.when(F.size("kw") == 0, 1.0).otherwise(F.coalesce(F.size(f"t{n}"), F.lit(0)) / F.size("kw"))
        spr = F.when(F.coalesce(f"n{n}", F.lit(0)) < 2, 0.0).otherwise(F.col(f"h{n}") - F.col(f"l{n}"))
        reason = F.when(F.lit(s >= most), "max_k").when(F.lit(s > initial) & (spr < spread), "low_spread").when(cov >= coverage, "coverage_met").otherwise("expand")
        tried.append(F.struct(F.lit(s).alias("k"), F.round(cov, 6).alias("coverage"), F.round(spr, 6).alias("spread"), reason.alias("reason")))
    t = t.withColumn("steps", F.array(*tried)).withColumn("at", F.get(F.filter("steps", lambda x: x["reason"] != "expand"), 0))
    return t.select("query_id", F.col("at.k").alias("final_k"), F.col("at.coverage").alias("coverage"), F.col("at.spread").alias("spread"), F.col("at.reason").alias("reason"))


def sentence_score(sentence: Column, kw: Column) -> Column:
    """Jaccard of keyword sets plus a small bonus for length, at most 1."""
    s = F.array_distinct(F.filter(letter_words(sentence), lambda t: ~t.isin(*KEYWORD_STOP)))
    base = F.size(F.array_intersect(kw, s)) / F.size(F.array_union(kw, s)) + 0.1 * F.log(F.size(s) + 1) / 5.0
    return F.when((F.size(kw) == 0) | (F.size(s) == 0), 0.0).otherwise(F.least(base, F.lit(1.0)))


def sentence_compressed(results: DataFrame, threshold: float = 0.12, min_sentences: int = 1, max_sentences: int | None = None, separator: str = " … ") -> DataFrame:
    """results (query, content) with compressed, ratio, relevance and the retained sentences. The relevance is that of the compressed
    text split again, as consumers of the joined text see it."""
    r = results.withColumn("_kw", keywords(F.col("query"))).withColumn("_s", sentences_before_capital(F.col("content")))
    r = r.withColumn("_x", F.transform("_s", lambda s, i: F.struct((-F.round(sentence_score(s, F.col("_kw")), 12)).alias("neg"), i.alias("i"), s.alias("s"))))
    above = F.filter("_x", lambda x: -x["neg"] >= threshold)
    best = F.array_sort(F.transform(F.slice(F.array_sort("_x"), 1, min_sentences), lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))))
    kept = F.when(F.size(above) < min_sentences, F.transform(best, lambda x: x["s"])).otherwise(F.transform(above, lambda x: x["s"]))
    r = r.withColumn("retained", F.slice(kept, 1, max_sentences) if max_sentences is not None else kept)
    r = r.withColumn("compressed", F.when(F.size("_s") == 0, F.col("content")).otherwise(F.array_join("retained", separator)))
    again = sentences_before_capital(F.col("compressed"))
    score = F.when(F.size(again) == 0, 0.0).otherwise(F.aggregate(again, F.lit(0.0), lambda a, s: a + sentence_score(s, F.col("_kw"))) / F.size(again))
    return r.withColumn("ratio", F.length("compressed") / F.greatest(F.length("content"), F.lit(1))).withColumn("relevance", score).drop("_kw", "_s", "_x")


def keyword_compressed(results: DataFrame, min_sentences: int = 1, separator: str = " … ") -> DataFrame:
    """Sentences with a query keyword; if too few, those with most hits. relevance: kept of all."""
    r = results.withColumn("_kw", keywords(F.col("query"))).withColumn("_s", sentences_before_capital(F.col("content")))
    hits = lambda s: F.size(F.array_intersect(F.col("_kw"), F.array_distinct(letter_words(s))))
    r = r.withColumn("_x", F.transform("_s", lambda s, i: F.struct((-hits(s)).alias("neg"), i.alias("i"), s.alias("s"))))
    above = F.filter("_x", lambda x: x["neg"] < 0)
    best = F.array_sort(F.transform(F.slice(F.array_sort("_x"), 1, min_sentences), lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))))
    r = r.withColumn("retained", F.when(F.size(above) < min_sentences, F.transform(best, lambda x: x["s"])).otherwise(F.transform(above, lambda x: x["s"])))
    r = r.withColumn("compressed", F.array_join("retained", separator)).withColumn("ratio", F.length("compressed") / F.greatest(F.length("content"), F.lit(1)))
    return r.withColumn("relevance", F.when(F.size("_s") == 0, 0.0).otherwise(F.size("retained") / F.size("_s"))).drop("_kw", "_s", "_x")


def term_overlap(results: DataFrame) -> DataFrame:
    """matched query keywords (sorted) and their share."""
    kw = keywords(F.col("query"))
    got = F.array_sort(F.array_intersect(kw, F.array_distinct(letter_words(F.col("content")))))
    return results.withColumn("matched_terms", got).withColumn("overlap", F.when(F.size(kw) == 0, 0.0).otherwise(F.size(got) / F.size(kw)))


def contributions(results: DataFrame, subs: DataFrame, k: int = 60) -> DataFrame:
    """results (query_id, chunk_id) with each sub-query's (query_id, sub, chunk_id, rank) share of the fused score; 0 where absent."""
    ways = subs.select("query_id", "sub").distinct()
    return results.join(ways, "query_id").join(subs.select("query_id", "sub", "chunk_id", F.col("rank").alias("sub_rank")), ["query_id", "sub", "chunk_id"], "left").withColumn("contribution", F.coalesce(1 / (F.lit(k) + F.col("sub_rank")), F.lit(0.0)))


def explanation() -> Column:
    """One line of a result with term_overlap: rank, score, share of terms."""
    return F.format_string("#%d score=%.4f terms=%.0f%%", "rank", "score", F.col("overlap") * 100)
