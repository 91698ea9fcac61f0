"""N-gram Jaccard join by parity sketches.

A document's set of word shingles is dealt over the parts of its size band by a hash of each shingle, a few shingles a part. A part's key is the XOR of its
shingles' hashes, so two documents differ in at most |A ^ B| parts, and a document's parity sketch (one bit a bucket, flipped by
each shingle) has a Hamming distance of at most |A ^ B|. Jaccard >= t bounds |A ^ B| by (1 - t) / (1 + t) * (|A| + |B|); a document
therefore emits, in a fixed order of parts, its first d + 1 keys that hold anything, where d is that bound for its largest partner:
by the pigeonhole principle any two similar documents of a band emit an equal key. Bands overlap by 1 / t, so similar documents
share a band.

Exactness does not depend on which shingles come first, so shingles that batches find frequent are dealt to the last parts: a
passage that a third of all documents carry then yields no key unless a document is made of little else.

Copies (equal sets) are one class and only classes are joined. In each key one class is first verified against all others (a star): the
one that meets most others in all its keys, which is the middle of a group of near copies and reaches most of it. Then every pair of one
key that the stars have left in different components, and whose sizes and sketches allow the similarity, is verified; of keys with the
same sets left, one is enough. Sketches grow with the sets, so that they tell long texts apart that share passages only. So no link
between components is lost, and no group of near copies is expanded into all its pairs.

Defined results: null, empty or blank text has an empty set, links with nothing and is its own component. A text of fewer words than
the shingle length has its whole sequence as one shingle. Equal texts are one class. Extra columns are ignored; an empty table gives
an empty result. Ties: the smallest id names a class and a component. Ids are integers; rows with a null id are left out, rows that repeat one are each returned.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BITMAP, Texts, bitmap, checkpoint, mix64, signed, small_batches
from .components import components

BAND = 3  # a band holds sizes of one to BAND / threshold times its least
SHINGLES = 3  # of a band's largest sets, in a part on average: sets that share a passage only then rarely share a part
FEW = 256  # bands from here on have parts of so many; below, a part is about one shingle, so that none of the first d + 1 is missing
SKETCH_WORDS = 8  # 512 bits
HOT_SHINGLES = 1 << 20  # at most so many frequent shingles are told to all tasks: 8 MB
HOT_SHARE = 0.02  # of a batch's documents


def shingle_sets(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts together, and each text's offsets."""
    t = Texts(text, lower=True)
    w = t.words()
    h = w.hashes()
    at, g = w.windows(k, h)
    doc = w.doc[at]
    for n in range(1, k):  # texts of fewer words: one shingle, told apart by its length
        short = np.flatnonzero(w.count == n)
        if len(short):
            x = np.zeros(len(short), np.uint64)
            for j in range(n):
                x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + h[w.off[short] + j] + np.uint64(n))
            doc, g = np.concatenate([doc, short]), np.concatenate([g, x])
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    doc, g = doc[new], g[new]
    return g, np.searchsorted(doc, np.arange(t.n + 1))


def set_ids(g: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set."""
    def total(x: np.ndarray) -> np.ndarray:
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        return c[off[1:]] - c[off[:-1]]

    n = np.diff(off).astype(np.uint64)
    return signed(mix64(total(mix64(g ^ np.uint64(0x5851F42D4C957F2D))) + n)), signed(total(mix64(g ^ np.uint64(0x14057B7EF767814F))))


def sketches(g: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Parity sketch of each set: SKETCH_WORDS 64-bit words."""
    bits = 64 * SKETCH_WORDS
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    odd = np.bincount(doc * bits + (mix64(g ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(bits)).astype(np.int64), minlength=(len(off) - 1) * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(off) - 1, bits), axis=1, bitorder="little").view(np.int64)


def long_sketches(g: np.ndarray, off: np.ndarray) -> list[np.ndarray | None]:
    """Parity sketches of at least a bit a shingle, as 64-bit words, of sets for which the short ones have less; a power of two of words,
    so that a longer one folds onto a shorter by XOR."""
    h, out = mix64(g ^ np.uint64(0x7FB5D329728EA185)), []
    for a, b in zip(off[:-1], off[1:]):
        bits = 64 * SKETCH_WORDS
        while bits < b - a:
            bits *= 2
        odd = np.bincount((h[a:b] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 if bits > 64 * SKETCH_WORDS else None
        out.append(None if odd is None else np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
    return out


def emitted(g: np.ndarray, hot: np.ndarray, threshold: Fraction) -> np.ndarray:
    """The keys of one set: those of its first d + 1 parts that hold anything, in each band that it belongs to."""
    n = len(g)
    m = int((1 - threshold) / (1 + threshold) * (n + n / threshold)) + 1
    order = mix64(g ^ np.uint64(0x9FB21C651E98DF25))
    if len(hot):
        late = hot[np.minimum(np.searchsorted(hot, g), len(hot) - 1)] == g
        order = (order >> np.uint64(1)) | (late.astype(np.uint64) << np.uint64(63))
    else:
        order = order >> np.uint64(1)
    by = np.argsort(order)
    order, x = order[by], mix64(g[by] ^ np.uint64(0xD6E8FEB86659FD93))
    out, top, least = [], 0, 1
    while least * BAND <= n:
        least, top = least * BAND, top + 1
    for band in (top, top - 1):  # the band below also holds what is at most 1 / threshold above its end
        low = BAND**band
        if band < 0 or n < low or n * threshold >= low * BAND:
            continue
        # singletons, in effect, in the lowest bands
        parts = 1 << 32 if low < 64 else int(low * BAND / threshold / (SHINGLES if low >= FEW else 1))
        part = ((order >> np.uint64(31)) * np.uint64(parts)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        keys = np.bitwise_xor.reduceat(x, first)[:m]
        out.append(mix64(keys + mix64(part[first][:m] + np.uint64(band << 40))))
    return np.concatenate(out)


def _long_distance(x: Column, y: Column) -> Column:
    """Hamming distance of two long sketches, at most the size of the sets' symmetric difference; null where a set has none."""
    def fold(v: Column, w: Column) -> Column:
        """v of the length of w, where it is longer."""
        n = F.size(w)
        parts = F.transform(F.sequence(F.lit(0), F.size(v) - n, n), lambda i: F.slice(v, i + 1, n))
        folded = F.aggregate(parts, F.array_repeat(F.lit(0).cast("long"), n), lambda a, b: F.zip_with(a, b, lambda s, t: s.bitwiseXOR(t)))
        return F.when(F.size(v) > n, folded).otherwise(v)

    bits = F.zip_with(fold(x, y), fold(y, x), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return F.when(x.isNotNull() & y.isNotNull(), F.aggregate(bits, F.lit(0), lambda a, b: a + b))


def _similar(threshold: Fraction) -> Column:
    """Whether sizes and sketches of x and y allow the similarity."""
    p, q = threshold.numerator, threshold.denominator
    sizes = (F.least("x.n", "y.n") * q >= F.greatest("x.n", "y.n") * p)
    most = (F.col("x.n") + F.col("y.n")) * (q - p)
    distance = sum((F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))
    return sizes & (distance * (q + p) <= most) & F.coalesce(_long_distance(F.col("x.sk"), F.col("y.sk")) * (q + p) <= most, F.lit(True))


def ngram_jaccard_join(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: Fraction | str = Fraction(4, 5)
) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has id_col, n_shingles, class_id and component_id of every document; links has the verified pairs of
    class ids (a < b) that were compared, enough to connect every component."""
    spark = docs.sparkSession
    threshold = Fraction(threshold)
    small_batches(spark)
    src = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            g, off = shingle_sets(b.column(1), k)
            s1, s2 = set_ids(g, off)
            sk = sketches(g, off)
            n = b.num_rows
            cols = {"doc_id": b.column(0), "n": np.diff(off).astype(np.int64), "sid": s1, "sid2": s2} | {f"s{i}": sk[:, i] for i in range(SKETCH_WORDS)} | {"sk": pa.array(long_sketches(g, off), pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict({c: v if isinstance(v, pa.Array) else pa.array(np.ascontiguousarray(v)) for c, v in cols.items()})
            # shingles that many of a batch's distinct sets share: same schema, doc_id null
            _, first = np.unique(s1, return_index=True)
            parts = [g[off[i] : off[i + 1]] for i in first]
            v, c = np.unique(np.concatenate(parts) if parts else g, return_counts=True)
            often = c >= max(4, HOT_SHARE * n)
            if often.any():
                zero = np.zeros(int(often.sum()), np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(len(zero), pa.int64()), "n": pa.array(c[often].astype(np.int64)), "sid": pa.array(signed(v[often])), "sid2": pa.array(zero)} | {f"s{i}": pa.array(zero) for i in range(SKETCH_WORDS)} | {"sk": pa.nulls(len(zero), pa.list_(pa.int64()))})

    sk_cols = [f"s{i}" for i in range(SKETCH_WORDS)]
    seen = checkpoint(src.mapInArrow(profile, "doc_id long, n long, sid long, sid2 long, " + ", ".join(f"{c} long" for c in sk_cols) + ", sk array<long>"))
    profiles = seen.where("doc_id is not null")
    counts = seen.where("doc_id is null").groupBy("sid").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "sid").limit(HOT_SHINGLES)
    hot = spark.sparkContext.broadcast(np.sort(np.array([r.sid for r in counts.select("sid").collect()], np.int64).view(np.uint64)))

    full = profiles.where("n > 0")
    classes = full.groupBy("sid", "sid2", "n").agg(F.min("doc_id").alias("rep"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hot.value
        for b in batches:
            g, off = shingle_sets(b.column(1), k)
            s1, _ = set_ids(g, off)
            kk, ss = [], []
            for i in np.unique(s1, return_index=True)[1]:  # copies in a batch emit once
                if off[i + 1] > off[i]:
                    kk.append(emitted(g[off[i] : off[i + 1]], h, threshold))
                    ss.append(np.full(len(kk[-1]), s1[i]))
            if kk:
                yield pa.RecordBatch.from_pydict({"key": pa.array(signed(np.concatenate(kk))), "sid": pa.array(np.concatenate(ss))})

    rows = src.mapInArrow(keys, "key long, sid long")
    often = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    shared = checkpoint(rows.join(often, "key", "left_semi"))  # rows whose key another row has too

    needed = classes.join(shared.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.min("rep").alias("rep"))
    bare = checkpoint(full.select(F.col("doc_id").alias("rep"), "n", *sk_cols, "sk").join(needed, "rep").dropDuplicates(["rep"]))
    shared = shared.distinct()
    crowd = shared.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    shared = checkpoint(shared.join(crowd, "key"))
    # how many others a set meets, over all its keys; the low bits break ties
    met = shared.groupBy("sid").agg(F.sum("c").alias("w")).select("sid", F.shiftleft("w", 16).bitwiseOR(F.col("sid").bitwiseAND(F.lit(0xFFFF))).alias("w"))
    shared = shared.drop("c").join(met, "sid")
    lead = shared.groupBy("key").agg(F.max_by("sid", "w").alias("lo"))
    shared = checkpoint(shared.join(lead, "key").where("sid <> lo").select("key", "sid", "lo"))
    star = shared.select(F.col("lo").alias("p"), F.col("sid").alias("q")).distinct()

    x, y = bare.alias("x"), bare.alias("y")
    star = star.join(x, F.col("p") == F.col("x.sid")).join(y, (F.col("q") == F.col("y.sid")) & _similar(threshold))
    star = checkpoint(star.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct())
    links = verified(src, star, k, threshold)
    comp = components(links)

    # what the stars have left apart: the leader has met all others of its key
    of = checkpoint(bare.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    left = shared.select("key", "sid").join(of.select("sid", "component"), "sid")
    told = [F.min("component").alias("u"), F.max("component").alias("v"), F.count("*").alias("c"), F.bit_xor("sid").alias("s"), F.bit_xor(F.xxhash64("sid")).alias("t")]
    one = left.groupBy("key").agg(*told).where("u < v").groupBy("c", "s", "t").agg(F.min("key").alias("key")).select("key")
    at = checkpoint(shared.select("key", "sid").join(one, "key", "left_semi").join(of, "sid"))
    x, y = at.alias("x"), at.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.sid") < F.col("y.sid")) & (F.col("x.component") != F.col("y.component")) & _similar(threshold))
    rest = pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    rest = checkpoint(rest.join(star, ["a", "b"], "left_anti"))
    more = verified(src, rest, k, threshold)
    links = links.union(more)
    comp = components(comp.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more))

    # written down, so that the join of all documents is a plain one, which adaptive execution splits where a text has very many copies
    of_class = checkpoint(classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("sid", "sid2", "n", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id")))
    members = full.join(of_class, ["sid", "sid2", "n"]).select("doc_id", "n", "class_id", "component_id")
    members = members.union(profiles.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id")))
    return members.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", "component_id"), links


def texts_of(src: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (doc_id, text) of the ids. The bitmap spares the shuffle of all other texts; the semi-join is exact."""
    told = src.sparkSession.sparkContext.broadcast(bitmap(ids))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = told.value
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False) % BITMAP
            yield b.filter(pa.array((bits[h // 32] >> (h % 32)) & 1 == 1))

    near = src.select("doc_id", "text").mapInArrow(some, "doc_id long, text string")
    return checkpoint(near.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"))


def verified(src: DataFrame, pairs: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) whose whole texts reach the threshold."""
    if pairs.isEmpty():
        return pairs.select("a", "b")
    p, q = threshold.numerator, threshold.denominator
    ids = checkpoint(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    texts = texts_of(src, ids)
    joined = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def sets(ids: list[int], col: pa.Array) -> list[np.ndarray]:
            new = [i for i, d in enumerate(ids) if d not in known]
            if new:
                g, off = shingle_sets(col.take(pa.array(new)), k)
                own = {ids[i]: g[off[j] : off[j + 1]] for j, i in enumerate(new)}
            else:
                own = {}
            out = [own[d] if d in own else known[d] for d in ids]
            known.update(own)
            while len(known) > 64:
                known.popitem(last=False)
            return out

        for b in batches:
            ia, ib = b.column(0).to_pylist(), b.column(1).to_pylist()
            keep = []
            for x, y in zip(sets(ia, b.column(2)), sets(ib, b.column(3))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * q >= p * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return checkpoint(joined.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long"))
