"""Retrieval metrics over runs (query_id, doc_id, rank) and qrels (query_id, doc_id, relevance), and answer-quality metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, spaced, word_tokens


def ir_per_query(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """recall, precision, ap, ndcg at k and rr (no cut) of every query of the run. The ideal list is cut to what was retrieved;
    precision divides by what was retrieved; repeated documents count again."""
    w = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    rel = qrels.where("relevance > 0").dropDuplicates(["query_id", "doc_id"])
    hits = run.join(rel, ["query_id", "doc_id"], "left").withColumn("pos", F.row_number().over(w)).withColumn("hit", F.col("relevance").isNotNull().cast("int"))
    cum = F.sum("hit").over(w.rowsBetween(Window.unboundedPreceding, 0))
    hits = hits.withColumn("prec", F.when((F.col("hit") == 1), cum / F.col("pos")))
    inside = F.col("pos") <= k
    got = hits.groupBy("query_id").agg(
        F.sum(F.when(inside, F.col("hit"))).alias("hits"),
        F.sum(inside.cast("int")).alias("retrieved"),
        F.coalesce(F.sum(F.when(inside, F.col("prec"))), F.lit(0.0)).alias("prec_sum"),
        F.sum(F.when(inside, F.coalesce(F.col("relevance"), F.lit(0.0)) / F.log2(F.col("pos") + 1))).alias("dcg"),
        F.min(F.when(F.col("hit") == 1, F.col("pos"))).alias("first"),
    )
    ideal = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id")
    best = rel.withColumn("i", F.row_number().over(ideal)).join(got.select("query_id", "retrieved"), "query_id").where(F.col("i") <= F.col("retrieved")).groupBy("query_id").agg(F.sum(F.col("relevance") / F.log2(F.col("i") + 1)).alias("idcg"))
    n_rel = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    t = got.join(n_rel, "query_id", "left").join(best, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return t.select(
        "query_id",
        zero(F.col("hits") / F.col("n_rel")).alias("recall"),
        zero(F.col("hits") / F.when(F.col("retrieved") > 0, F.col("retrieved"))).alias("precision"),
        zero(F.col("prec_sum") / F.col("n_rel")).alias("ap"),
        zero(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))).alias("ndcg"),
        zero(1 / F.col("first")).alias("rr"),
    )


def ir_report(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """One row of means."""
    p = ir_per_query(run, qrels, k)
    names = {"recall": "mean_recall", "precision": "mean_precision", "ap": "map", "ndcg": "mean_ndcg", "rr": "mrr"}
    return p.agg(*[F.round(F.avg(c), 6).alias(a) for c, a in names.items()], F.count("*").alias("n_queries"))


def _share(tokens: Column, pool: Column) -> Column:
    """Share of the tokens, repeats counted, that the pool has; 1 for none."""
    return F.when(F.size(tokens) == 0, 1.0).otherwise(F.size(F.filter(tokens, lambda t: F.array_contains(pool, t))) / F.size(tokens))


def token_f1(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when(both == 0, 0.0).otherwise(2.0 * both / (F.size(x) + F.size(y)))


def exact_form(text: Column) -> Column:
    return spaced(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", ""))


def answer_metrics(samples: DataFrame) -> DataFrame:
    """samples (sample_id, question, contexts, answer, reference) with one column per metric."""
    s = samples.withColumn("_a", word_tokens(F.coalesce("answer", F.lit("")))).withColumn("_q", word_tokens(F.coalesce("question", F.lit(""))))
    s = s.withColumn("_r", word_tokens(F.coalesce("reference", F.lit(""))))
    s = s.withColumn("_c", F.transform(F.coalesce("contexts", F.array()), lambda c: word_tokens(c)))
    s = s.withColumn("_pool", F.array_distinct(F.flatten("_c")))
    qa = F.array_distinct(F.concat("_q", "_a"))
    near = F.size(F.filter("_c", lambda c: jaccard(F.array_distinct(c), qa) >= 0.05))
    wanted = F.when(F.size("_r") > 0, F.col("_r")).otherwise(F.col("_a"))
    has_ref = F.coalesce(F.col("reference"), F.lit("")) != ""
    return s.select(
        "sample_id",
        _share(F.col("_a"), F.col("_pool")).alias("faithfulness"),
        F.when(F.size("_c") == 0, 0.0).otherwise(near / F.size("_c")).alias("context_precision"),
        _share(wanted, F.col("_pool")).alias("context_recall"),
        jaccard(F.array_distinct("_q"), F.array_distinct("_a")).alias("answer_relevance"),
        F.when(has_ref, (exact_form(F.col("answer")) == exact_form(F.col("reference"))).cast("double")).otherwise(0.0).alias("exact_match"),
        F.when(has_ref, token_f1(F.col("_a"), F.col("_r"))).otherwise(0.0).alias("token_f1"),
    )


METRICS = ("faithfulness", "context_precision", "context_recall", "answer_relevance", "exact_match", "token_f1")


def answer_report(scored: DataFrame, names: tuple[str, ...] = METRICS) -> DataFrame:
    """(metric, mean)"""
    return scored.unpivot("sample_id", list(names), "metric", "value").groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"))
