"""Dense retrieval: exact top-k of a batch of queries against a table of vectors, with metadata filters pushed below it."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import against
from .ranking import PLACES, checked_k, top_k

PAIRS = 1 << 22  # scores that a task holds at once


class MetadataFilter(NamedTuple):
    """field, operator (eq neq gt gte lt lte in not_in contains), value. A missing value passes only neq and not_in."""

    field: str
    operator: str
    value: Any

    def column(self) -> Column:
        c, v = F.col(self.field), self.value
        made = {
            "eq": lambda: c == v,
            "neq": lambda: ~c.eqNullSafe(v),
            "gt": lambda: c > v,
            "gte": lambda: c >= v,
            "lt": lambda: c < v,
            "lte": lambda: c <= v,
            "in": lambda: c.isin(*v),
            "not_in": lambda: c.isNull() | ~c.isin(*v),
            "contains": lambda: F.contains(c.cast("string"), F.lit(v)),
            "contains_item": lambda: F.array_contains(c, v),
        }
        if self.operator not in made:
            raise ValueError(f"no such operator: {self.operator}")
        return F.coalesce(made[self.operator](), F.lit(False))


def filtered(df: DataFrame, filters: Sequence[MetadataFilter] = (), equal: Mapping[str, Any] | None = None) -> DataFrame:
    """Rows that pass all filters; applied before scoring, so the parquet scan sees them."""
    conds = [f.column() for f in filters] + [F.col(k).eqNullSafe(v) for k, v in (equal or {}).items()]
    return df.where(reduce(Column.__and__, conds)) if conds else df


def block_scores(v: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Scores of all pairs of rows of v and q in double precision; higher is nearer."""
    if metric == "euclidean":  # by differences: products would lose the digits of near vectors
        return 1 / (1 + np.sqrt(((v[:, None, :] - q[None, :, :]) ** 2).sum(axis=2)))
    dots = v @ q.T
    if metric == "dot":
        return dots
    if metric != "cosine":
        raise ValueError(f"no such metric: {metric}")
    n = np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]
    return np.where(n == 0, 0.0, dots / np.where(n == 0, 1.0, n))


def best_of(s: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of every column of s, ties by place: rows and columns."""
    best = [np.lexsort((place, -s[:, j]))[:k] if len(s) <= 4 * k else top_of(s[:, j], place, k) for j in range(s.shape[1])]
    return np.concatenate(best) if best else np.zeros(0, np.int64), np.repeat(np.arange(s.shape[1]), [len(x) for x in best])


def matrix(column: pa.ChunkedArray, n: int | None = None) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False).astype(float) if column.num_chunks else np.zeros(0)
    n = n or (len(flat) // len(column) if len(column) else 0)
    if len(flat) != len(column) * n or set(pc.list_value_length(column).unique().to_pylist()) - {n}:
        raise ValueError("vectors of different length")
    return flat.reshape(len(column), n)


def candidates(rows: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    """(query_id, chunk_id, score): the k best of every block of rows for every query, each pair of blocks as one matrix product."""

    def scored(mine: pa.Table, asked: pa.Table) -> Iterator[pa.RecordBatch]:
        q = matrix(asked.column(1))
        v = matrix(mine.column(1), q.shape[1])
        place = np.argsort(np.argsort(mine.column(0).to_numpy(), kind="stable"), kind="stable")
        step = max(1, PAIRS // (len(v) * (q.shape[1] if metric == "euclidean" else 1)))
        for at in range(0, len(q), step):
            s = np.round(block_scores(v, q[at : at + step], metric), PLACES)
            row, of = best_of(s, place, k)
            yield from pa.table([asked.column(0).take(pa.array(at + of)), mine.column(0).take(pa.array(row)), pa.array(s[row, of])], ["query_id", "chunk_id", "score"]).to_batches()

    of = {"query_id": queries.schema["query_id"].dataType, "chunk_id": rows.schema["chunk_id"].dataType}
    schema = ", ".join(f"{c} {t.simpleString()}" for c, t in of.items()) + ", score double"
    mine = rows.where("embedding is not null").select("chunk_id", F.col("embedding").cast("array<double>"))
    asked = queries.where("vector is not null").select("query_id", F.col("vector").cast("array<double>"))
    return against(mine, asked, scored, schema)


def top_of(s: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The k rows of highest score, ties by place."""
    least = np.partition(s, len(s) - k)[len(s) - k]
    near = np.flatnonzero(s >= least)
    return near[np.lexsort((place[near], -s[near]))[:k]]


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, *, metric: str = "cosine", filters: Sequence[MetadataFilter] = (), threshold: float | None = None) -> DataFrame:
    """vectors (chunk_id, embedding, ...), queries (query_id, vector). The vectors are read once for all queries; only the k best of a
    block are shuffled. A null vector is nowhere, vectors of different lengths raise."""
    return top_k(candidates(filtered(vectors, filters), queries, checked_k(k), metric), k, threshold=threshold)
