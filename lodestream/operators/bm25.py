"""Sparse retrieval: a persisted index of term counts, its statistics, and batched BM25 top-k.

The index is built in one pass over the texts: a row a chunk with its distinct terms and their counts, in the chunks' own order, so
building it shuffles only a count a term. Queries are a DataFrame (query_id, query). Blocks of index rows meet blocks of queries and sum
their scores where they are read: what is shuffled are the k best of a block, never a posting. For few queries against a large index see
segments.py, which reads the postings of their terms only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BM25_STOP, bm25_tokens
from .blocks import against
from .dense import best_of
from .ranking import PLACES, checked_k, top_k
from .tables import shared_dir, spread

K1, B, EPSILON = 1.5, 0.75, 0.25


def token_lists(chunks: DataFrame, content: str = "content", stop: tuple[str, ...] = BM25_STOP) -> DataFrame:
    return spread(chunks).withColumn("tokens", bm25_tokens(F.coalesce(F.col(content), F.lit("")), stop))


def term_counts(chunks: DataFrame, content: str = "content") -> DataFrame:
    """(chunk_id, len, terms, tfs): tokens are sorted in their row, and the places where the term changes give its counts."""
    t = token_lists(chunks, content).select("chunk_id", F.size("tokens").alias("len"), F.array_sort("tokens").alias("tokens"))
    first = F.expr("filter(sequence(1, size(tokens)), i -> i = 1 or element_at(tokens, i) <> element_at(tokens, i - 1))")
    t = t.withColumn("at", F.when(F.col("len") > 0, first).otherwise(F.array().cast("array<int>")))
    tfs = F.expr("transform(at, (x, i) -> coalesce(get(at, i + 1), len + 1) - x)")
    return t.select("chunk_id", "len", F.transform("at", lambda i: F.element_at("tokens", i)).alias("terms"), tfs.alias("tfs"))


class Index(NamedTuple):
    """chunks (chunk_id, len, terms, tfs), terms (term, df), and the path that both are written under."""

    chunks: DataFrame
    terms: DataFrame
    path: str

    @classmethod
    def build(cls, chunks: DataFrame, path: str | None = None, content: str = "content") -> Index:
        spark = chunks.sparkSession
        path = path or f"{shared_dir(spark)}/lodestream/bm25-{uuid.uuid4().hex}"
        term_counts(chunks, content).write.parquet(f"{path}/chunks")
        each = spark.read.parquet(f"{path}/chunks").select(F.explode("terms").alias("term"))
        each.groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{path}/terms")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/terms"), path)

    def stats(self) -> DataFrame:
        """One row: n chunks, avgdl, total tokens."""
        return self.chunks.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), F.sum("len").alias("total_tokens"))

    def without(self, ids: DataFrame) -> Index:
        """The index without the chunks of `ids` (chunk_id); statistics follow."""
        left = self.chunks.join(ids.select("chunk_id"), "chunk_id", "left_anti")
        return Index(left, left.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), self.path)

    def idf(self, n: int, epsilon: float = EPSILON) -> DataFrame:
        return self.terms.withColumn("idf", F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), F.lit(epsilon)))

    def asked(self, queries: DataFrame, n: int) -> DataFrame:
        """(query_id, terms, weights): the distinct terms of each query that the index has; a term counts as often as the query repeats it."""
        each = queries.select("query_id", F.explode(bm25_tokens(F.coalesce("query", F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        told = each.join(self.idf(n).select("term", "idf"), "term").groupBy("query_id").agg(F.collect_list(F.struct("term", (F.col("qtf") * F.col("idf")).alias("weight"))).alias("x"))
        return told.select("query_id", F.col("x.term").alias("terms"), F.col("x.weight").alias("weights"))

    def scores(self, queries: DataFrame, k: int | None = None, *, k1: float = K1, b: float = B) -> DataFrame:
        """(query_id, chunk_id, score) of every chunk that shares a term; with k only the k best of each block of chunks."""
        s = self.stats().collect()[0]  # one row
        norm = F.lit(k1) * (1 - b + b * F.col("len") / (s["avgdl"] or 1.0))
        rows = self.chunks.where("len > 0").select("chunk_id", norm.alias("norm"), "terms", "tfs")
        of = {"query_id": queries.schema["query_id"].dataType, "chunk_id": rows.schema["chunk_id"].dataType}
        schema = ", ".join(f"{c} {t.simpleString()}" for c, t in of.items()) + ", score double"
        return against(rows, self.asked(queries, s["n"]), lambda mine, asked: block_scores(mine, asked, k, k1), schema, most=2048, most_asked=512)

    def top_k(self, queries: DataFrame, k: int = 10, **kw) -> DataFrame:
        """A chunk's terms stand in one row, so its scores are summed where it is read; the k best of a block of rows are shuffled."""
        return top_k(self.scores(queries, checked_k(k), **kw), k)


ADDS = 1 << 22  # products of a term's weight and count that are summed at once


def block_scores(mine: pa.Table, asked: pa.Table, k: int | None, k1: float) -> Iterator[pa.RecordBatch]:
    """Scores of a block of index rows (chunk_id, norm, terms, tfs) for a block of queries (query_id, terms, weights)."""
    query = np.repeat(np.arange(len(asked)), pc.list_value_length(asked.column(1)).to_numpy())
    words = pc.list_flatten(asked.column(1)).combine_chunks().dictionary_encode()
    term = words.indices.to_numpy()
    order = np.argsort(term, kind="stable")
    query, weight, first = query[order], pc.list_flatten(asked.column(2)).to_numpy()[order], np.searchsorted(term[order], np.arange(len(words.dictionary) + 1))

    sizes = pc.list_value_length(mine.column(2)).to_numpy()
    at = pc.index_in(pc.list_flatten(mine.column(2)).combine_chunks(), words.dictionary)
    known = at.is_valid().to_numpy(zero_copy_only=False)
    at, row = at.drop_null().to_numpy(), np.repeat(np.arange(len(mine)), sizes)[known]
    tf = pc.list_flatten(mine.column(3)).to_numpy()[known].astype(float)
    part = tf * (k1 + 1) / (tf + mine.column(1).to_numpy()[row])
    times = first[at + 1] - first[at]
    total = np.concatenate([[0], np.cumsum(np.bincount(row, times, len(mine)))])
    n, q, lo, sums = len(mine), len(asked), 0, []
    while lo < n:  # as many rows at once as make about ADDS products
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + ADDS, "right")) - 1)
        a, b = np.searchsorted(row, [lo, hi])
        t, m = at[a:b], times[a:b]
        place = np.arange(m.sum()) + np.repeat(first[t] - np.cumsum(m) + m, m)
        cell = np.repeat((row[a:b] - lo) * q, m) + query[place]
        sums.append(np.bincount(cell, np.repeat(part[a:b], m) * weight[place], (hi - lo) * q).reshape(hi - lo, q))
        lo = hi
    s = np.round(np.concatenate(sums), PLACES) if k else np.concatenate(sums)
    if k:
        id_place = np.argsort(np.argsort(mine.column(0).to_numpy(), kind="stable"), kind="stable")
        row, of = best_of(np.where(s > 0, s, -1.0), id_place, k)
        row, of = row[s[row, of] > 0], of[s[row, of] > 0]
    else:
        row, of = np.nonzero(s > 0)
    yield from pa.table([asked.column(0).take(pa.array(of)), mine.column(0).take(pa.array(row)), pa.array(s[row, of])], ["query_id", "chunk_id", "score"]).to_batches()


def corpus_stats(chunks: DataFrame, content: str = "content") -> DataFrame:
    """One row: n chunks, avgdl, total tokens."""
    return token_lists(chunks, content).agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"), F.sum(F.size("tokens")).alias("total_tokens"))


def term_stats(index: Index) -> DataFrame:
    """One row: vocabulary, corpus size, mean length (2 places), total tokens."""
    vocabulary = index.terms.agg(F.count("*").alias("vocabulary_size"))
    s = index.stats().select(F.col("n").alias("corpus_size"), F.round("avgdl", 2).alias("avg_doc_length"), "total_tokens")
    return vocabulary.join(F.broadcast(s))  # one row each


def bm25_top_k(chunks: DataFrame, queries: DataFrame, k: int = 10, *, content: str = "content", **kw) -> DataFrame:
    """Builds an index of the chunks and answers the queries from it."""
    return Index.build(chunks, content=content).top_k(queries, k, **kw)
