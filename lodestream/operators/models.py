"""Models of any kind behind one call: embedders, rerankers and chat services as functions over batches, with retries and errors kept
beside the rows they belong to. No client is built in: the function that is handed in may call one."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import top_k


class ModelError(Exception):
    """What a model function raises: retryable errors are tried again."""

    def __init__(self, message: str, retryable: bool = True) -> None:
        super().__init__(message)
        self.retryable = retryable


def called(df: DataFrame, f: Callable[[pd.DataFrame], Sequence], inputs: Sequence[str], into: str, kind: str, *, batch: int = 32, attempts: int = 3, delay: float = 0.1) -> DataFrame:
    """df with `into` (of type `kind`), error and latency_ms: f gets up to `batch` rows of the inputs at once and returns one value a row.
    A batch that fails is tried again, then row by row, so that one bad row costs no other its value; its error is its message."""
    cols = df.columns
    if clash := {into, "error", "latency_ms"} & set(cols):
        raise ValueError(f"columns in the way: {sorted(clash)}")

    def tried(part: pd.DataFrame) -> list:
        for n in range(attempts):
            try:
                out = list(f(part))
                if len(out) != len(part):
                    raise ModelError(f"{len(out)} values for {len(part)} rows", retryable=False)
                return out
            except Exception as e:
                if n == attempts - 1 or not getattr(e, "retryable", True):
                    raise
                time.sleep(delay * 2**n)
        return []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                start, errors = time.perf_counter(), [None] * len(part)
                try:
                    values = tried(part[list(inputs)])
                except Exception:
                    values = []
                    for i in range(len(part)):
                        try:
                            values += tried(part[list(inputs)].iloc[i : i + 1])
                        except Exception as e:
                            values.append(None)
                            errors[i] = f"{type(e).__name__}: {e}"
                ms = (time.perf_counter() - start) * 1000 / max(len(part), 1)
                yield part.assign(**{into: pd.Series(values, part.index, object), "error": errors, "latency_ms": ms})[[*cols, into, "error", "latency_ms"]]

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema) + f", `{into}` {kind}, error string, latency_ms double"
    return df.mapInPandas(run, schema)


def embedded(chunks: DataFrame, f: Callable[[pd.DataFrame], Sequence], *, content: str = "content", **kw) -> DataFrame:
    """chunks with embedding (and error): distinct texts are embedded once and joined back."""
    once = called(chunks.select(content).distinct(), f, [content], "embedding", "array<float>", **kw).drop("latency_ms")
    return chunks.join(once, content)


def reranked(ranked: DataFrame, f: Callable[[pd.DataFrame], Sequence], k: int = 10, *, query: str = "query", content: str = "content", **kw) -> DataFrame:
    """(query_id, chunk_id, score, original_rank, rank) by the model's score of each pair; pairs that fail keep no place."""
    scored = called(ranked.withColumnRenamed("rank", "original_rank").drop("score"), f, [query, content], "score", "double", **kw)
    return top_k(scored.where(F.col("error").isNull() & F.col("score").isNotNull()), k).select("query_id", "chunk_id", "score", "original_rank", "rank")


def answered(queries: DataFrame, f: Callable[[pd.DataFrame], Sequence], *, prompt: str = "prompt", **kw) -> DataFrame:
    """queries with answer, error and latency_ms: a batch of any size with its failures beside it."""
    return called(queries, f, [prompt], "answer", "string", **kw)
