"""Substring dedup by relative Lempel-Ziv parsing over partitioned reference blocks.

The reference is every earlier document. Its index holds where each run of `length` words starts first (document and place); it is
split by hash into blocks, and a document is looked up in all of them. From its first indexed run on, a document is factored: a factor
goes on in one reference document as long as the next run stands there at the next place. Where a factor ends, the runs that straddle
its end are looked up like any other and may begin the next factor inside it, so nothing is lost at factor boundaries. Every factor is
then compared with the words that stand in its reference; only factors that agree are duplicate spans.

What keeps the index small: equal documents are factored once; and only runs whose minimiser (the smallest hash among their
sub-runs of `anchor` words, which equal runs share) also stands in another document are indexed at all. Both steps are exact: they
leave out only runs that no other document has.

Hashes of runs have 64 bits, so two different runs may share an index entry: the factor then differs from its reference and is not
removed. Defined results: ids are integers. Null, empty and blank texts have no words; documents shorter than `length` words lose
nothing. Of equal documents only the smallest id keeps its words. Rows that repeat an id are no reference for each other; each row is
factored and returned by its own text. Null ids are left out. Other columns play no part; an empty table gives an empty result. Texts
are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BITMAP, Texts, Words, bitmap, checkpoint, covered, mix64, place_number, signed, small_batches, text_place


def run_starts(w: Words, k: int) -> np.ndarray:
    """First words of the runs of k words inside a text."""
    return np.flatnonzero(np.repeat(w.off[1:], w.count) - np.arange(len(w.start)) >= k)


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k neighbouring hashes, from those of the powers of two that make up k."""
    x, n, out, m = h, 1, None, 0
    while True:
        if k & n:
            out = x if out is None else both(out[: max(len(x) - m, 0)], x[m:])
            m += n
        if 2 * n > k:
            return mix64(out)
        x = both(x[:-n], x[n:])
        n *= 2


def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x


def least(x: np.ndarray, k: int) -> np.ndarray:
    """The smallest of every k neighbours."""
    n = 1
    while 2 * n <= k:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: max(len(x) - k + n, 0)], x[k - n :])


def minimisers(w: Words, h: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and minimiser of every run of `length` words inside a text. Sub-runs that cross the end of a text lie in none."""
    at = run_starts(w, length)
    return at, least(run_hashes(h, anchor), length - anchor + 1)[at] if len(at) else np.zeros(0, np.uint64)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def distinct(doc: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, x)."""
    new = changes(doc, x)  # neighbouring runs mostly have the same minimiser
    doc, x = doc[new], x[new]
    order = np.lexsort((x, doc))
    doc, x = doc[order], x[order]
    new = changes(doc, x)
    return doc[new], x[new]


def first_places(doc: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The first row of each (doc, run)."""
    if not len(doc):
        return np.zeros(0, np.int64)
    order = np.argsort(mix64(run + mix64(doc.astype(np.uint64))))
    return np.minimum.reduceat(order, np.flatnonzero(changes(doc[order], run[order])))


TEXT_SEEDS = (0x9E6C63D0876A9F43, 0x4CF5AD432745937F)


def text_id(w: Words, h: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit digest of each text's sequence of words."""
    place = np.arange(len(h)) - np.repeat(w.off[:-1], w.count)
    x = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h ^ mix64(place.astype(np.uint64) + np.uint64(seed))), dtype=np.uint64)])
    return signed(mix64(x[w.off[1:]] - x[w.off[:-1]] + w.count.astype(np.uint64)))


def text_words(t: Texts, i: int) -> list[bytes]:
    return t.data[t.off[i] : t.off[i + 1]].tobytes().split()


def kept_digest(words: list[bytes], keep: np.ndarray) -> str:
    return hashlib.sha256(b" ".join(compress(words, keep.tolist()))).hexdigest()


def factored(pos: np.ndarray, ref: np.ndarray, ref_pos: np.ndarray, length: int) -> list[tuple[int, int, int, int]]:
    """Factors (first and last word, reference document, place in it) of one document from the places of its indexed runs, sorted: a
    factor goes on while the next run stands in the same reference one place further on."""
    if not len(pos):
        return []
    on = (np.diff(pos) == 1) & (np.diff(ref_pos) == 1) & (ref[1:] == ref[:-1])
    begin = np.concatenate([[0], np.flatnonzero(~on) + 1])
    end = np.concatenate([begin[1:], [len(pos)]]) - 1
    return [(int(pos[i]), int(pos[j]) + length - 1, int(ref[i]), int(ref_pos[i])) for i, j in zip(begin, end)]


def word_digest(words: list[bytes], first: int, last: int) -> bytes:
    """128 bits of the words from first to last of a text."""
    return hashlib.blake2b(b" ".join(words[first : last + 1]), digest_size=16).digest()


SPANS = "spans array<struct<first:long,last:long>>"
SPAN_TYPE = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
FACTOR_TYPE = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("ref", pa.int64()), ("ref_pos", pa.int64()), ("digest", pa.binary())]))
FACTORS = "factors array<struct<first:long,last:long,ref:long,ref_pos:long,digest:binary>>"


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 13, anchor: int = 5) -> tuple[DataFrame, DataFrame]:
    """(documents, spans). documents: id_col, n_words, n_removed, kept_sha256. spans: id_col and, for each document that is not a whole
    copy but has factors, its duplicate spans as sorted (first, last) word places and its factors with their references."""
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    src = src.withColumn("at", text_place(F.col("text")))  # with the id, it tells rows apart

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = Texts(b.column(1))
            w = t.words()
            h = w.hashes()
            d1, d2 = (text_id(w, h, seed) for seed in TEXT_SEEDS)
            sha = [hashlib.sha256(b" ".join(text_words(t, i))).hexdigest() for i in range(t.n)]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "at": b.column(2), "n_words": pa.array(w.count.astype(np.int64)), "d1": pa.array(d1), "d2": pa.array(d2), "sha": pa.array(sha, pa.string())})

    profiles = checkpoint(src.mapInArrow(profile, "doc_id long, at long, n_words long, d1 long, d2 long, sha string"))
    # written down, so that joins on it are plain ones, which adaptive execution splits where a text has very many copies
    first = checkpoint(profiles.where(f"n_words >= {length}").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = Texts(b.column(1)).words()
            h = w.hashes()
            at, low = minimisers(w, h, length, anchor)
            doc, low = distinct(w.doc[at], low)
            d1 = text_id(w, h, TEXT_SEEDS[0])
            once = np.zeros(b.num_rows, bool)
            ids = b.column(0).to_numpy()
            order = np.lexsort((ids, d1))
            once[order[np.concatenate([[True], d1[order][1:] != d1[order][:-1]])]] = True  # equal texts of a batch: the smallest id
            keep = once[doc]
            doc, low = doc[keep], low[keep]
            yield pa.RecordBatch.from_pydict({"a": pa.array(signed(low)), "doc_id": pa.array(ids[doc]), "d1": pa.array(d1[doc])})

    rows = src.mapInArrow(anchors, "a long, doc_id long, d1 long")
    shared = rows.groupBy("a").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo < hi").select("a")
    held = rows.select("a", "doc_id").join(shared, "a", "left_semi").groupBy("doc_id").agg(F.collect_set("a").alias("anchors"))
    held = checkpoint(held.join(first.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"))

    told = spark.sparkContext.broadcast(bitmap(held.select(F.col("doc_id").alias("id"))))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = told.value
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            h = b.column(0).to_numpy() % BITMAP
            b = b.filter(pa.array((bits[h // 32] >> (h % 32)) & 1 == 1))
            packed = [pack.compress((t or "").encode()) for t in b.column(1).to_pylist()]  # texts travel from here on
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(packed, pa.binary())], ["doc_id", "at", "packed"])

    texts = checkpoint(src.mapInArrow(some, "doc_id long, at long, packed binary").join(held, "doc_id").select("doc_id", "at", "packed", "anchors"))

    def unpacked(column: pa.Array) -> Texts:
        d = zstandard.ZstdDecompressor()
        return Texts(pa.array([d.decompress(x).decode() for x in column.to_pylist()], pa.string()))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = unpacked(b.column(2)).words()
            h = w.hashes()
            at, low = minimisers(w, h, length, anchor)
            flat = b.column(3).flatten().to_numpy().view(np.uint64)
            own = np.repeat(np.arange(b.num_rows), b.column(3).value_lengths().to_numpy())
            new = changes(w.doc[at], low)
            keep = np.isin(mix64(low[new]) + mix64(w.doc[at[new]].astype(np.uint64)), mix64(flat) + mix64(own.astype(np.uint64)))
            at = at[keep[np.cumsum(new) - 1]]
            run, doc = run_hashes(h, length)[at] if len(at) else np.zeros(0, np.uint64), w.doc[at]
            by = first_places(doc, run)
            at, run, doc = at[by], run[by], doc[by]
            yield pa.RecordBatch.from_pydict({"run": pa.array(signed(run)), "doc_id": pa.array(b.column(0).to_numpy()[doc]), "pos": pa.array(b.column(1).to_numpy()[doc] + at - w.off[doc])})

    # pos: the row's place plus the number of the first word of the run where it stands first in the text
    index = texts.mapInArrow(indexed, "run long, doc_id long, pos long")
    earliest = index.groupBy("run").agg(F.min(F.struct("doc_id", "pos")).alias("ref"), F.max("doc_id").alias("hi")).where("ref.doc_id < hi").select("run", "ref")
    hits = index.join(earliest, "run").where("ref.doc_id < doc_id").select("doc_id", "pos", F.col("ref.doc_id").alias("ref"), F.col("ref.pos").alias("ref_pos"))
    row = (F.col("pos") - place_number(F.col("pos"))).alias("at")
    hits = hits.groupBy("doc_id", row).agg(F.collect_list(F.struct(place_number(F.col("pos")).alias("pos"), "ref", "ref_pos")).alias("hits"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = unpacked(b.column(2))
            w = t.words()
            at = run_starts(w, length)
            run = run_hashes(w.hashes(), length)[at] if len(at) else np.zeros(0, np.uint64)
            ends = np.searchsorted(w.doc[at], np.arange(b.num_rows + 1))
            n, sha, spans, factors = [], [], [], []
            for i in range(b.num_rows):
                own = b.column(3)[i].values
                first, ref, ref_pos = (own.field(k).to_numpy() for k in range(3))
                # a run that the text repeats has the reference of its first place
                _, at_first, same = np.unique(run[ends[i] : ends[i + 1]], return_index=True, return_inverse=True)
                hit = np.full(int(w.count[i]), -1)
                hit[first] = np.arange(len(first))
                hit = hit[at_first[same]]  # the k-th run of a text begins at its k-th word
                pos = np.flatnonzero(hit >= 0)
                hit = hit[pos]
                f = factored(pos, ref[hit], ref_pos[hit], length)
                gone = covered(pos, length, int(w.count[i]))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                n.append(int(gone.sum()))
                words = text_words(t, i)
                sha.append(kept_digest(words, ~gone))
                spans.append([{"first": int(x), "last": int(y) - 1} for x, y in zip(edge[::2], edge[1::2])])
                factors.append([{"first": x, "last": y, "ref": r, "ref_pos": p, "digest": word_digest(words, x, y)} for x, y, r, p in f])
            cols = [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, SPAN_TYPE), pa.array(factors, FACTOR_TYPE)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "at", "n_removed", "cut_sha", "spans", "factors"])

    schema = f"doc_id long, at long, n_removed long, cut_sha string, {SPANS}, {FACTORS}"
    cut = texts.drop("anchors").join(hits, ["doc_id", "at"]).dropDuplicates(["doc_id", "at"])
    cut = checkpoint(cut.mapInArrow(parse, schema))

    # every factor against the words that stand in its reference
    each = cut.select("doc_id", "at", F.explode("factors").alias("f")).select("doc_id", "at", "f.*", F.expr("f.last - f.first + 1").alias("n"))
    ref_row = (F.col("ref_pos") - place_number(F.col("ref_pos"))).alias("at")
    asked = each.select("ref", "ref_pos", "n").distinct().groupBy(F.col("ref").alias("doc_id"), ref_row).agg(F.collect_list(F.struct(place_number(F.col("ref_pos")).alias("first"), "n")).alias("asked"))

    def origin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = unpacked(b.column(2))
            out = []
            for i, (d, at, asked) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist())):
                words = text_words(t, i)
                out += [(d, at + x["first"], x["n"], word_digest(words, x["first"], x["first"] + x["n"] - 1)) for x in asked if x["first"] + x["n"] <= len(words)]
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["ref", "ref_pos", "n", "origin"])

    there = texts.drop("anchors").join(asked, ["doc_id", "at"]).mapInArrow(origin, "ref long, ref_pos long, n long, origin binary").distinct()
    wrong = checkpoint(each.join(there, ["ref", "ref_pos", "n"], "left").where(~F.col("digest").eqNullSafe(F.col("origin"))).select("doc_id", "at", "first", "last"))
    if not wrong.isEmpty():  # two different runs of one hash: cut those documents again without the factors that differ
        cut = checkpoint(recut(cut, wrong, texts, unpacked, schema))

    nothing = hashlib.sha256(b"").hexdigest()
    whole = profiles.join(first, ["d1", "d2"], "left").join(cut.select("doc_id", "at", "n_removed", "cut_sha"), ["doc_id", "at"], "left")
    copy = (F.col("n_words") >= length) & (F.col("rep") < F.col("doc_id"))
    out = whole.select(
        F.col("doc_id").alias(id_col),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(nothing)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )
    return out, cut.select(F.col("doc_id").alias(id_col), "spans", "factors")


def recut(cut: DataFrame, wrong: DataFrame, texts: DataFrame, unpacked, schema: str) -> DataFrame:  # noqa: ANN001
    """cut, with the documents of `wrong` cut by their other factors only."""
    again = wrong.groupBy("doc_id", "at").agg(F.collect_set(F.struct("first", "last")).alias("wrong"))
    some = cut.join(again, ["doc_id", "at"])
    some = some.select("doc_id", "at", F.filter("factors", lambda f: ~F.array_contains("wrong", F.struct(f["first"].alias("first"), f["last"].alias("last")))).alias("factors"))
    some = texts.drop("anchors").dropDuplicates(["doc_id", "at"]).join(some, ["doc_id", "at"]).select("doc_id", "at", "packed", "factors")

    def redo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = unpacked(b.column(2))
            w = t.words()
            n, sha, spans = [], [], []
            for i, factors in enumerate(b.column(3).to_pylist()):
                gone = np.zeros(int(w.count[i]), bool)
                for f in factors:
                    gone[f["first"] : f["last"] + 1] = True
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                n.append(int(gone.sum()))
                sha.append(kept_digest(text_words(t, i), ~gone))
                spans.append([{"first": int(x), "last": int(y) - 1} for x, y in zip(edge[::2], edge[1::2])])
            cols = [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, SPAN_TYPE), b.column(3).cast(FACTOR_TYPE)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "at", "n_removed", "cut_sha", "spans", "factors"])

    return cut.join(again, ["doc_id", "at"], "left_anti").unionByName(some.mapInArrow(redo, schema))
