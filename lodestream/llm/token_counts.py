"""Token counts by separator scan.

A flat token file is a run of little-endian 16- or 32-bit ids without an index; every document ends with the separator id. Files are
read in blocks; one vectorised search per block finds the separators, and a document that spans blocks is stitched by a prefix scan
over the blocks' summaries: how many separators came before, and how many tokens since the last of them.

Defined results: a document may be empty (two separators in a row count 0). Tokens after a file's last separator are one more
document with ended = false. Null or empty blocks hold no token. Blocks of a file may come in any order and partition; repeated
(file, block) rows, or a block that is not a whole number of ids, raise. An empty table gives an empty result. Other columns of the
blocks are handed on as `extra` only where asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, small_batches

SEPARATOR = 50256
BLOCK_BYTES = 1 << 20
# Fixed value: how the byte-level vocabulary splits texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def file_blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, data) of the flat files under a path that Spark reads. A file is in memory once while it is cut, so shards should
    be of a few hundred MB."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                raw = memoryview(data.as_buffer())
                for k, at in enumerate(range(0, len(raw), block_bytes)):
                    yield pa.RecordBatch.from_pydict({"file": [name], "block": pa.array([k], pa.int64()), "data": pa.array([raw[at : at + block_bytes].tobytes()], pa.binary())})

    small_batches(spark, 1)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cut, "file string, block long, data binary")


def summarise(blocks: DataFrame, separator: int, width: int, extra: str | None) -> DataFrame:
    """file, block, n tokens, k separators, tail tokens after the last one, and the tokens before the first and between them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k, tail, lens = [], [], [], []
            for x in b.column(2):
                ids = np.frombuffer(x.as_buffer() if x.is_valid else b"", f"<u{width}")
                at = np.flatnonzero(ids == separator)
                n.append(len(ids))
                k.append(len(at))
                tail.append(len(ids) - (at[-1] + 1 if len(at) else 0))
                lens.append(np.diff(at, prepend=-1) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, pa.int64()) for v in (n, k, tail)), pa.array(lens, pa.list_(pa.int64())), *b.columns[3:]], ["file", "block", "n", "k", "tail", "lens", *(["extra"] if extra else [])])

    kind = blocks.schema["file"].dataType.simpleString()
    cols = ["file", "block", "data", *([extra] if extra else [])]
    schema = f"file {kind}, block long, n long, k long, tail long, lens array<long>" + (f", extra {blocks.schema[extra].dataType.simpleString()}" if extra else "")
    return blocks.select(cols).mapInArrow(scan, schema)


def separator_scan(blocks: DataFrame, *, separator: int = SEPARATOR, width: int = 2, extra: str | None = None) -> DataFrame:
    """file, block, first (place in the file of the first document that ends in the block), counts (of the documents that end in it),
    ended, and extra. A last document without a separator has a row of its own, with ended = false."""
    s = checkpoint(summarise(blocks, separator, width, extra))
    w = Window.partitionBy("file").orderBy("block")  # one small row a block
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    scan = s.select("file", "block", "k", "tail").withColumn("sum", F.coalesce(F.sum("tail").over(before), F.lit(0))).withColumn("first", F.coalesce(F.sum("k").over(before), F.lit(0)))
    scan = scan.withColumn("reset", F.when(F.col("k") > 0, F.col("sum")))
    scan = scan.withColumn("carry", F.col("sum") - F.coalesce(F.last("reset", ignorenulls=True).over(before), F.lit(0)))
    scan = scan.withColumn("twice", F.lag("block").over(w) == F.col("block")).withColumn("end", F.lead("block").over(w).isNull())
    scan = scan.withColumn("carry", F.when(F.coalesce("twice", F.lit(False)), F.raise_error(F.lit("a block of a file came twice"))).otherwise(F.col("carry")))
    full = s.join(scan.select("file", "block", "first", "carry", "end"), ["file", "block"])
    counts = F.transform("lens", lambda x, i: F.when(i == 0, x + F.col("carry")).otherwise(x))
    more = [F.col("extra")] if extra else []
    done = full.where("k > 0").select("file", "block", "first", counts.alias("counts"), F.lit(True).alias("ended"), *more)
    left = F.col("tail") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)
    rest = full.where(F.col("end") & (left > 0)).select("file", "block", (F.col("first") + F.col("k")).alias("first"), F.array(left).alias("counts"), F.lit(False).alias("ended"), *more)
    return done.union(rest)


def token_counts(blocks: DataFrame, *, separator: int = SEPARATOR, width: int = 2) -> DataFrame:
    """One row per document: file, place (from 0), n_tokens, ended."""
    s = separator_scan(blocks, separator=separator, width=width)
    return s.select("file", "first", F.posexplode("counts").alias("i", "n_tokens"), "ended").select("file", (F.col("first") + F.col("i")).alias("place"), "n_tokens", "ended")


def tokenised(docs: DataFrame, ranks_file: str, *, id_col: str = "doc_id", text_col: str = "text", separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents as flat token files in blocks (file, block, data), one file per input partition, with the ids of the documents
    that end in each block (ids). A null text is an empty document."""
    import base64

    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    told = docs.sparkSession.sparkContext.broadcast(ranks)
    half = block_bytes // 2

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=told.value, special_tokens={})
        file, k = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        ends: list[tuple[int, int]] = []
        size = 0

        def block(n: int) -> pa.RecordBatch:
            nonlocal held, ends, size, k
            ids = np.concatenate(held) if held else np.zeros(0, "<u2")
            mine = [d for d, e in ends if e <= n]
            ends = [(d, e - n) for d, e in ends if e > n]
            held, size = [ids[n:]], len(ids) - n
            k += 1
            return pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int64()), "block": pa.array([k - 1], pa.int64()), "data": pa.array([ids[:n].tobytes()], pa.binary()), "ids": pa.array([mine], pa.list_(pa.int64()))})

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.asarray([*enc.encode_ordinary(t or ""), separator], "<u2")
                held.append(ids)
                size += len(ids)
                ends.append((d, size))
                while size >= half:
                    yield block(half)
        if size:
            yield block(size)

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(flat, "file long, block long, data binary, ids array<long>")
