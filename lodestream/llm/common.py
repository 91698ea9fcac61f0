"""Shared pieces of the training-data operators: vectorised text arithmetic over Arrow buffers and a few Spark helpers.

Words are maximal runs of bytes other than space and \\t..\\r, so a word never splits a UTF-8 code point.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import shared_dir, spread

SPACES = (0x20, *range(0x09, 0x0E))
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so that powers can be inverted modulo 2**64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; a small one of few files is dealt over the cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Python workers get at most so many rows at once: a row may be a whole book."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it


def give_back() -> None:
    """Freed memory goes back to the system. A Python worker outlives its task, and what it holds counts against its executor while others work."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def text_place(text: Column) -> Column:
    """31 bits of a text's hash in the upper half of a long; the lower half takes the number of a line or word. With the id of the row,
    it tells rows apart that repeat an id with another text."""
    return F.shiftleft(F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)), 32)


def place_number(pos: Column) -> Column:
    return pos.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for what runs inside; the caller's come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse, grown on demand and kept for the life of the worker."""

    def __init__(self) -> None:
        self.n = 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n)
            self.up, self.down = _powers(_BASE, self.n), _powers(pow(_BASE, -1, 1 << 64), self.n)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Texts:
    """The texts of one batch as a single byte array; text i is data[off[i]:off[i + 1]]. A null text is an empty one."""

    def __init__(self, column: pa.Array | pa.ChunkedArray, lower: bool = False) -> None:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        arr = pc.fill_null(column.cast(pa.large_string()), "")
        self.n = len(arr)
        _, off, data = arr.buffers()
        o = np.frombuffer(off, np.int64)[arr.offset : arr.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data, self.off = raw[o[0] : o[-1]], o - o[0]
        if lower:
            self.data = _LOWER[self.data]

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        c = np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])
        return c[self.off[1:]] - c[self.off[:-1]]

    def words(self) -> "Words":
        return Words(self)

    def spans_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte span; equal bytes give equal hashes wherever they stand."""
        n = len(self.data)
        up, down = _POWERS.get(n + 1)
        s = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[:n], out=s[1:])
        return mix64((s[end] - s[start]) * down[start] + (end - start).astype(np.uint64))


class Words:
    """start, end: byte spans; doc: the text that each word stands in; off: word offsets of the texts; hash: 64 bits a word."""

    def __init__(self, t: Texts) -> None:
        self.t = t
        solid = ~_IS_SPACE[t.data]
        first = np.zeros(len(solid) + 1, bool)
        first[t.off] = True  # a text's first byte never continues the text before
        before = np.concatenate([[False], solid[:-1]]) if len(solid) else solid
        self.start = np.flatnonzero(solid & (~before | first[:-1]))
        after = np.concatenate([solid[1:], [False]]) if len(solid) else solid
        self.end = np.flatnonzero(solid & (~after | first[1:])) + 1
        self.off = np.searchsorted(self.start, t.off)
        self.count = np.diff(self.off)
        self.doc = np.repeat(np.arange(t.n), self.count)

    def hashes(self) -> np.ndarray:
        return self.t.spans_hash(self.start, self.end)

    def windows(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The first word's index and the hash of every run of k words inside one text."""
        return windows(self.hashes() if hashes is None else hashes, self.off, k)


def windows(h: np.ndarray, off: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Runs of k hashes that cross no offset: index of the first, and a hash of the sequence."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.full(n - k + 1, np.uint64(seed))
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15 ^ (seed << 1)) + mix64(h[j : n - k + 1 + j] + np.uint64((j + 1) * 0x632BE59BD9B4E019 & _MASK))
    left = np.repeat(off[1:], np.diff(off))[: n - k + 1] - np.arange(n - k + 1)  # words from here to the end of the text
    at = np.flatnonzero(left >= k)
    return at, mix64(out[at])


def covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n positions lie in a run of k that starts at one of `at`."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, at, 1)
    np.add.at(d, np.minimum(at + k, n), -1)
    return np.cumsum(d[:n]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


# The shuffle files of a table that is written down go with the end of its write.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder: survives lost executors, and takes less disk than serialised rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestream/{uuid.uuid4().hex}"
    with settings(spark, FREED):
        df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """As checkpoint, bucketed by a column: grouping or joining by it shuffles only the other side."""
    spark = df.sparkSession
    name = f"lodestream_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with settings(spark, FREED):
        df.write.bucketBy(n, column).option("compression", "zstd").saveAsTable(name, format="parquet", path=f"{shared_dir(spark)}/lodestream/{name}")
    return spark.table(name)


BITMAP = 33_554_393  # bits (4 MB as packed words), a prime: ids that follow one another spread evenly


def bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of the column id modulo BITMAP, of fixed size. It lets through every id in it and, while it is sparse, few others."""
    h = F.pmod(F.col("id"), F.lit(BITMAP))
    words = ids.select(h.alias("h")).distinct().select(F.floor(F.col("h") / 32).alias("w"), F.expr("shiftleft(1L, int(h % 32))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most BITMAP / 32 rows
    out = np.zeros(BITMAP // 32 + 1, np.int64)
    out[words.w.to_numpy(np.int64)] = words.b.to_numpy(np.int64)
    return out
