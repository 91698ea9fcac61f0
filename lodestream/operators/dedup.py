"""Duplicates among documents and among the results of a query.

Result lists are bounded by their top-k; the greedy rules (keep in rank order, drop what is near an earlier kept one) run per list.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import char_shingles, content_hash, loose
from .tables import spread

SEEDS = 128
STRETCH, GRAMS, KNOWN = 1 << 20, 1 << 16, 1 << 19  # characters and grams taken at once; grams whose hashes a task keeps


def first_seen(docs: DataFrame, order: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per content hash, the first in order. The minimum is taken before the shuffle."""
    h = spread(docs).withColumn("content_hash", content_hash(F.coalesce(F.col(text), F.lit(""))))
    first = h.groupBy("content_hash").agg(F.min(order).alias(order))
    return h.join(first, ["content_hash", order], "left_semi")


def is_duplicate(docs: DataFrame, registry: DataFrame, text: str = "text") -> DataFrame:
    """Rows of docs whose hash the registry (content_hash) has."""
    return spread(docs).withColumn("content_hash", content_hash(F.col(text))).join(registry.select("content_hash").distinct(), "content_hash", "left_semi")


def registry_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    n = spread(docs).select(content_hash(F.col(text)).alias("h")).groupBy("h").agg(F.count("*").alias("c"))
    return n.agg(F.sum("c").alias("total_seen"), F.sum(F.col("c") - 1).alias("duplicates_skipped"), F.count("*").alias("unique_loaded"))


def write_first_seen(docs: DataFrame, path: str, order: str = "doc_id", text: str = "text") -> dict[str, int]:
    """Writes the first row of every content hash, and gives the statistics of registry_stats from the same job: they are observed as
    the rows are written, and no row is read again for them."""
    row = F.struct(*docs.columns)
    h = spread(docs).groupBy(content_hash(F.coalesce(F.col(text), F.lit(""))).alias("content_hash")).agg(F.min_by(row, order).alias("row"), F.count("*").alias("c"))
    seen = Observation()
    counts = (F.sum("c").alias("total_seen"), F.sum(F.col("c") - 1).alias("duplicates_skipped"), F.count("*").alias("unique_loaded"))
    h.observe(seen, *counts).select("content_hash", "row.*").write.parquet(path)
    return {k: v or 0 for k, v in seen.get.items()}


def exact_groups(ranked: DataFrame, content: str = "content") -> DataFrame:
    """Result rows with canonical_rank: the rank of the first result of the list with the same loose text."""
    w = Window.partitionBy("query_id", F.md5(loose(F.col(content))))
    return ranked.withColumn("canonical_rank", F.min("rank").over(w))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]]


def grams(text: str) -> np.ndarray:
    """The distinct runs of three characters, each as one number, sorted; a shorter text is its own run, an empty one has none. A long
    text is taken in stretches."""
    out = []
    for i in range(0, max(len(text) - 2, min(len(text), 1)), STRETCH):
        c = np.frombuffer(text[i : i + STRETCH + 2].encode("utf-32-le"), np.uint32).astype(np.uint64)
        c = np.pad(c, (0, max(0, 3 - len(c))))
        out.append(_distinct(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]))
    return out[0] if len(out) == 1 else _distinct(np.concatenate([np.zeros(0, np.uint64), *out]))


_PLACES = np.arange(8, dtype=np.uint16) * np.uint16(256)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)  # exact as far as counts go


class Votes:
    """The votes of texts on the 64 bits of their simhash; a gram is hashed once, until more than KNOWN are kept.

    known: sorted, with an end mark. bins: of each of the eight bytes of a gram's hash, 256 times its place, plus the byte. A text's
    counted bins, times the bits of each byte, are the ones of its bits."""

    def __init__(self) -> None:
        self.known, self.bins = np.full(1, ~np.uint64(0)), np.zeros((1, 8), np.uint16)

    def learn(self, new: np.ndarray) -> None:
        """The last 64 bits of MD5, the highest bit first."""
        texts = ("".join(chr(c) for b in (42, 21, 0) if (c := g >> b & 0x1FFFFF)) for g in new.tolist())
        raw = b"".join(hashlib.md5(t.encode(), usedforsecurity=False).digest()[8:] for t in texts)
        at = np.searchsorted(self.known, new)
        self.known = np.insert(self.known, at, new)
        self.bins = np.insert(self.bins, at, np.frombuffer(raw, np.uint8).reshape(-1, 8) + _PLACES, axis=0)

    def of(self, each: list[np.ndarray]) -> np.ndarray:
        """64 votes for each text's grams, the highest bit first."""
        if len(self.known) > KNOWN:
            self.__init__()
        n, all_ = np.array([len(g) for g in each]), np.concatenate(each)
        at = np.searchsorted(self.known, all_)
        if len(new := all_[self.known[at] != all_]):
            self.learn(_distinct(new))
            at = np.searchsorted(self.known, all_)
        bins = self.bins[at] + np.repeat(np.arange(len(each)) * 2048, n)[:, None]
        ones = np.bincount(bins.ravel(), minlength=len(each) * 2048).reshape(-1, 8, 256) @ _BITS
        return 2 * ones.reshape(-1, 64).astype(np.int64) - n[:, None]


def simhash_rows(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, hi, lo): the two 32-bit halves of each simhash. A text's distinct grams are counted in Python as numbers, in time linear in
    the text but for a sort; the votes of rows of one key are summed."""
    d = spread(docs.select(key, text)).select(key, loose(F.coalesce(F.col(text), F.lit(""))).alias("t"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes()
        for b in batches:
            each, size, done = [], 0, 0
            for i, t in enumerate(b.column(1)):
                each.append(grams(t.as_py()))
                size += len(each[-1])
                if size >= GRAMS or len(each) == 256 or i + 1 == b.num_rows:
                    v = votes.of(each)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(v)), pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * 64, v.ravel())], [key, "votes"])
                    each, size, done = [], 0, i + 1

    v = d.mapInArrow(vote, f"`{key}` {docs.schema[key].dataType.simpleString()}, votes array<long>")
    s = v.groupBy(key).agg(*[F.sum(F.get("votes", F.lit(i))).alias(f"v{i}") for i in range(64)])
    half = lambda first: sum((F.when(F.col(f"v{first + i}") > 0, F.lit(1 << 31 - i)).otherwise(F.lit(0)) for i in range(32)), F.lit(0))
    return s.select(key, half(0).cast("long").alias("hi"), half(32).cast("long").alias("lo"))


def minhash(grams: Column, seeds: int = SEEDS) -> Column:
    """Minima, per seed, of the first 32 bits of MD5(seed as four little-endian bytes, then the shingle); no shingle gives all ones."""
    def one(i: Column) -> Column:
        le = F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(i, 8 * b).bitwiseAND(F.lit(255))), 2, "0") for b in range(4)]))
        return F.coalesce(F.array_min(F.transform(grams, lambda g: F.conv(F.substring(F.md5(F.concat(le, F.encode(g, "utf-8"))), 1, 8), 16, 10).cast("long"))), F.lit((1 << 32) - 1))

    return F.transform(F.sequence(F.lit(0), F.lit(seeds - 1)), one)


def minhash_rows(docs: DataFrame, text: str = "text", key: str = "doc_id", seeds: int = SEEDS, k: int = 3) -> DataFrame:
    """(key, signature): the same minima by exploding shingles, one aggregate a seed: for whole texts."""
    t = docs.select(key, loose(F.coalesce(F.col(text), F.lit(""))).alias("t"))  # once, not once a shingle
    g = t.select(key, F.explode_outer(char_shingles(F.col("t"), k)).alias("g"))
    one = lambda i: F.conv(F.substring(F.md5(F.concat(F.lit(i.to_bytes(4, "little")), F.encode("g", "utf-8"))), 1, 8), 16, 10).cast("long")
    return g.groupBy(key).agg(F.array(*[F.coalesce(F.min(one(i)), F.lit((1 << 32) - 1)) for i in range(seeds)]).alias("signature"))


def estimated_jaccard(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def greedy_by_hamming(ranked: DataFrame, limit: int = 3) -> DataFrame:
    """ranked (query_id, chunk_id, rank, hi, lo) with kept_as: the rank of the kept result each one is within `limit` bits of."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        kept: list[tuple[int, int]] = []
        out = []
        for r, hi, lo in zip(pdf["rank"], pdf.hi, pdf.lo):
            x = int(hi) << 32 | int(lo)
            home = next((k for k, y in kept if (x ^ y).bit_count() <= limit), None)
            if home is None:
                kept.append((r, x))
            out.append(r if home is None else home)
        return pdf.assign(kept_as=out)[["query_id", "chunk_id", "rank", "kept_as"]]

    kinds = {c: ranked.schema[c].dataType.simpleString() for c in ("query_id", "chunk_id", "rank")}
    return ranked.select("query_id", "chunk_id", "rank", "hi", "lo").groupBy("query_id").applyInPandas(fold, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", kept_as int")


def greedy_by_minhash(ranked: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The same over signatures (query_id, chunk_id, rank, signature): estimated Jaccard of at least the threshold."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        kept: list[tuple[int, np.ndarray]] = []
        out = []
        for r, s in zip(pdf["rank"], pdf.signature):
            home = next((k for k, y in kept if np.mean(s == y) >= threshold), None)
            if home is None:
                kept.append((r, s))
            out.append(r if home is None else home)
        return pdf.assign(kept_as=out)[["query_id", "chunk_id", "rank", "kept_as"]]

    kinds = {c: ranked.schema[c].dataType.simpleString() for c in ("query_id", "chunk_id", "rank")}
    return ranked.select("query_id", "chunk_id", "rank", "signature").groupBy("query_id").applyInPandas(fold, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", kept_as int")


def chained(ranked: DataFrame, *stages) -> DataFrame:
    """Each stage works on what the one before kept."""
    for stage in stages:
        ranked = stage(ranked)
    return ranked
