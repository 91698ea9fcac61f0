"""Diversity selection over bounded result lists: both rules are sequential by nature and run per query over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _unit(vectors: pd.Series) -> np.ndarray:
    v = np.stack([np.asarray(x, float) for x in vectors])
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.where(n > 0, v / np.where(n > 0, n, 1), 0)


def _schema(ranked: DataFrame) -> str:
    return ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in ("query_id", "chunk_id")) + ", score double, rank int"


def mmr(ranked: DataFrame, k: int = 10, trade: float = 0.5) -> DataFrame:
    """ranked (query_id, chunk_id, rank, vector, embedding): at each step the result of highest trade * similarity to the query less
    (1 - trade) * highest similarity to a selected one; ties go to the better rank. The score returned is the query similarity."""

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        d, q = _unit(pdf.embedding), _unit(pdf.vector.iloc[:1])[0]
        sim = d @ q
        near, left, out = np.zeros(len(d)), np.ones(len(d), bool), []
        for step in range(min(k, len(d))):
            value = np.where(left, np.round(trade * sim - (1 - trade) * near, 12), -np.inf)
            i = int(np.argmax(value))
            left[i] = False
            near = d @ d[i] if step == 0 else np.maximum(near, d @ d[i])
            out.append(i)
        return pd.DataFrame({"query_id": pdf.query_id.iloc[0], "chunk_id": pdf.chunk_id.iloc[out], "score": sim[out], "rank": np.arange(1, len(out) + 1, dtype=np.int32)})

    return ranked.select("query_id", "chunk_id", "rank", "vector", "embedding").groupBy("query_id").applyInPandas(select, _schema(ranked))


def greedy_diverse(ranked: DataFrame, max_similarity: float = 0.85) -> DataFrame:
    """Results in rank order, without those more similar than that to one kept before."""

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        d, out = _unit(pdf.embedding), []
        for i in range(len(d)):
            if not out or (d[out] @ d[i]).max() <= max_similarity:
                out.append(i)
        return pd.DataFrame({"query_id": pdf.query_id.iloc[0], "chunk_id": pdf.chunk_id.iloc[out], "score": pdf.score.iloc[out], "rank": np.arange(1, len(out) + 1, dtype=np.int32)})

    return ranked.select("query_id", "chunk_id", "score", "rank", "embedding").groupBy("query_id").applyInPandas(select, _schema(ranked))
