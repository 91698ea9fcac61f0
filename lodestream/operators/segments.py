"""A sparse index of segments: add, remove, merge, and top-k that reads only the postings of the query's terms.

Every change writes a new folder and, last of all, a row of the log; readers follow the log, so a change that failed is not there.

* `add` writes a segment: its chunks with their terms and counts, and its postings, clustered by term in buckets (folders). A posting row
  is a block of up to BLOCK chunks of one term with its largest count and shortest length. A frequent term's blocks come from many tasks.
* `remove` writes tombstones, and counts down what the removed chunks had counted up.
* `merge` writes the live chunks as one segment.

Statistics are sums over the log and its term counts, never a pass over the chunks. Segments are numbered; a tombstone holds for the
segments before it, so a chunk can come back.

Search is exact. The query's strongest terms are scored first: the k-th best of these partial scores is a bound that the result must
reach. Blocks whose largest possible score, with the best of all other terms, stays below it are skipped; terms too weak to reach it even
together are scored for the chunks that the others found. Only the buckets that the terms hash to are read.

Ids that the index has are skipped by `add`; of rows of one id in a batch the one of smallest content counts. Null content has no terms.
One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import bm25_tokens
from .bm25 import EPSILON, K1, B, term_counts
from .ranking import checked_k, top_k
from .tables import shared_dir, table_of

BUCKETS = 64
BLOCK = 128  # chunks of a posting row
PUSHED = 10  # terms that are pushed down to the scan as a list
FIRST = 32  # times k: chunks that the bound is taken from
ULPS = 2e-6  # scores are rounded to six places before they are ranked


def bucket(term: str = "term"):  # noqa: ANN201
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(chunks: DataFrame) -> DataFrame:
    """(bucket, term, max_tf, min_len, ids, tfs, lens) of chunks (chunk_id, len, terms, tfs), sorted by bucket and term in each task."""
    spark = chunks.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = chunks.select("chunk_id", "len", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select(bucket("x.terms").alias("bucket"), F.col("x.terms").alias("term"), "chunk_id", F.col("x.tfs").alias("tf"), "len")
    order = ["bucket", "term", "chunk_id"]  # the id deals a frequent term to several tasks

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            code = b.column(1).dictionary_encode().indices.to_numpy()
            at = np.arange(len(code))
            new = np.concatenate([[True], code[1:] != code[:-1]])
            start = np.flatnonzero(new | ((at - np.maximum.accumulate(np.where(new, at, 0))) % BLOCK == 0))
            off = pa.array(np.append(start, len(code)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(off, b.column(c)) for c in (2, 3, 4)]
            tf, size = b.column(3).to_numpy(), b.column(4).to_numpy()
            head = pa.array(start)
            bounds = [pa.array(np.maximum.reduceat(tf, start)), pa.array(np.minimum.reduceat(size, start))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(head), b.column(1).take(head), *bounds, *lists], ["bucket", "term", "max_tf", "min_len", "ids", "tfs", "lens"])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return each.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(pack, f"bucket int, term string, max_tf int, min_len int, ids array<{kind}>, tfs array<int>, lens array<int>")


@dataclass
class SegmentedIndex:
    spark: SparkSession
    path: str

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None) -> SegmentedIndex:
        return cls(spark, path or f"{shared_dir(spark)}/lodestream/segments-{uuid.uuid4().hex}")

    # the log: one row a change
    def log(self) -> list:
        """(op, kind, n, tokens, since) in order; since: the first segment that a reader still needs."""
        try:
            return sorted(self.spark.read.parquet(f"{self.path}/log").collect())  # a row a change
        except Exception as e:  # noqa: BLE001  nothing was added yet
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def _commit(self, op: int, kind: str, n: int, tokens: int, since: int) -> None:
        row = self.spark.createDataFrame([(op, kind, n, tokens, since)], "op int, kind string, n long, tokens long, since int")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _live(self) -> tuple[list[int], list[int]]:
        """The segments and the tombstones that count."""
        log = self.log()
        since = log[-1].since if log else 0
        return [r.op for r in log if r.kind in ("add", "merge") and r.n and r.op >= since], [r.op for r in log if r.kind == "remove" and r.op > since]

    def _read(self, what: str, ops: list[int]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{what}").parquet(*(f"{self.path}/{what}/op={i}" for i in ops))

    def _alive(self, rows: DataFrame) -> DataFrame:
        """rows (op, chunk_id, ...) without those that a later tombstone names."""
        gone = self._live()[1]
        if not gone:
            return rows
        g = self._read("gone", gone).groupBy("chunk_id").agg(F.max("op").alias("until"))
        return rows.join(g, "chunk_id", "left").where(F.col("until").isNull() | (F.col("until") < F.col("op"))).drop("until")

    def chunks(self) -> DataFrame | None:
        """(chunk_id, len, terms, tfs) of the live chunks; None where there is no segment."""
        segments = self._live()[0]
        return self._alive(self._read("chunks", segments)).drop("op") if segments else None

    def stats(self) -> tuple[int, int]:
        """Live chunks and their tokens, from the log."""
        log = self.log()
        since = log[-1].since if log else 0
        live = [r for r in log if r.op >= since]
        return sum(r.n for r in live), sum(r.tokens for r in live)

    def terms(self) -> DataFrame:
        """(term, df) over the live chunks."""
        segments, gone = self._live()
        return self._read("terms", sorted(segments + gone)).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def _write_segment(self, op: int, counted: DataFrame) -> tuple[int, int]:
        counted.write.parquet(f"{self.path}/chunks/op={op}")
        rows = self.spark.read.parquet(f"{self.path}/chunks/op={op}")
        postings(rows).write.partitionBy("bucket").parquet(f"{self.path}/postings/op={op}")
        self._write_terms(op, rows, 1)
        s = rows.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).collect()[0]  # one row
        return s[0], s[1]

    def _write_terms(self, op: int, rows: DataFrame, sign: int) -> None:
        df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg((F.count("*") * sign).alias("df"))
        df.sort("term").write.parquet(f"{self.path}/terms/op={op}")

    def add(self, chunks: DataFrame, content: str = "content") -> int:
        """Adds the chunks (chunk_id, content) that the index has not; how many these are."""
        log = self.log()
        op = log[-1].op + 1 if log else 0
        new = chunks.groupBy("chunk_id").agg(F.min(content).alias("content"))
        have = self.chunks()
        if have is not None:
            new = new.join(have.select("chunk_id"), "chunk_id", "left_anti")
        n, tokens = self._write_segment(op, term_counts(new))
        self._commit(op, "add", n, tokens, log[-1].since if log else 0)
        return n

    def remove(self, ids: DataFrame) -> int:
        """Removes the chunks of ids (chunk_id); how many the index had."""
        log, have = self.log(), self.chunks()
        if have is None:
            return 0
        op = log[-1].op + 1
        have.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").write.parquet(f"{self.path}/gone/op={op}")
        rows = self.spark.read.parquet(f"{self.path}/gone/op={op}")
        self._write_terms(op, rows, -1)
        s = rows.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).collect()[0]  # one row
        self._commit(op, "remove", -s[0], -s[1], log[-1].since)
        return s[0]

    def merge(self) -> None:
        """The live chunks as one segment; tombstones are gone. Old folders stay for readers that began before."""
        log, have = self.log(), self.chunks()
        if have is None:
            return
        op = log[-1].op + 1
        n, tokens = self._write_segment(op, have)
        self._commit(op, "merge", n, tokens, op)

    def clear(self) -> None:
        """Readers begin after this change."""
        if log := self.log():
            self._commit(log[-1].op + 1, "clear", 0, 0, log[-1].op + 1)

    def asked(self, queries: DataFrame, epsilon: float = EPSILON) -> DataFrame:
        """(query_id, term, bucket, df, weight) of the queries' terms that the index has."""
        n, _ = self.stats()
        each = queries.select("query_id", F.explode(bm25_tokens(F.coalesce("query", F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), F.lit(epsilon))
        return each.join(self.terms(), "term").select("query_id", "term", bucket().alias("bucket"), "df", (F.col("qtf") * idf).alias("weight"))

    def top_k(self, queries: DataFrame, k: int = 10, *, k1: float = K1, b: float = B) -> DataFrame:
        """(query_id, chunk_id, score, rank): the rows of a scan over the whole index, from the postings that can matter."""
        checked_k(k)
        segments, _ = self._live()
        if not segments:
            return self.spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id long, score double, rank int")
        n, tokens = self.stats()
        avgdl = tokens / n if n and tokens else 1.0
        saturated = lambda tf, size: tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / avgdl))
        terms = table_of(self.asked(queries))
        keys = ["bucket", "term"]
        wanted = [r.bucket for r in terms.select("bucket").distinct().collect()]  # no more than BUCKETS
        blocks = self._read("postings", segments).where(F.col("bucket").isin(wanted))
        few = [r.term for r in terms.select("term").distinct().limit(PUSHED + 1).collect()]
        if len(few) <= PUSHED:  # then Parquet skips the row groups of other terms
            blocks = blocks.where(F.col("term").isin(few))

        # the best that each term can add, over its blocks' bounds: no posting is read for it
        bound = (F.col("weight") * saturated(F.col("max_tf"), F.col("min_len"))).alias("bound")
        best = blocks.select(*keys, "max_tf", "min_len").join(F.broadcast(terms) if _small(terms) else terms, keys).groupBy("query_id", *keys, "weight", "df").agg(F.max(bound).alias("best"))
        by = Window.partitionBy("query_id").orderBy(F.desc("best"), "term")  # a row a term of a query
        best = best.withColumn("before", F.coalesce(F.sum("df").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        best = best.withColumn("weaker", F.sum("best").over(by.rowsBetween(0, Window.unboundedFollowing))).withColumn("all", F.sum("best").over(Window.partitionBy("query_id")))
        best = table_of(best)

        def parts(of: DataFrame, more: str = "true") -> DataFrame:
            """(query_id, chunk_id, part) of the postings of these terms, in blocks that pass."""
            hit = blocks.join(F.broadcast(of) if _small(of) else of, keys).where(more)
            each = hit.select("op", "query_id", "weight", F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("x"))
            each = each.select("op", "query_id", F.col("x.ids").alias("chunk_id"), (F.col("weight") * saturated(F.col("x.tfs"), F.col("x.lens"))).alias("part"))
            return self._alive(each)

        strongest = parts(best.where(F.col("before") < FIRST * k)).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("part"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("part")))
        least = strongest.withColumn("place", place).where(F.col("place") == k).select("query_id", (F.col("part") - ULPS).alias("least"))
        told = table_of(best.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0))))

        able = F.col("weight") * saturated(F.col("max_tf"), F.col("min_len")) + F.col("all") - F.col("best") >= F.col("least")
        strong = parts(told.where("weaker >= least"), able).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("part"))
        weak = told.where("weaker < least")
        rest = weak.groupBy("query_id").agg(F.sum("best").alias("rest"), F.max("least").alias("least"))
        found = strong.join(rest, "query_id", "left").where("rest is null or part + rest >= least").select("query_id", "chunk_id", "part")
        found = table_of(found)
        more = parts(weak, able).join(found.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi").select("query_id", "chunk_id", "part")
        return top_k(found.unionByName(more).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score")).where("score > 0"), k)


TOLD = 1_000_000  # rows of a table of ours that are told to all tasks


def _small(df: DataFrame) -> bool:
    return df.count() <= TOLD  # of a written table: its footers

