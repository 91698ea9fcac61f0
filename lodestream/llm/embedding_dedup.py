"""Embedding near-dedup, exact: cells that overlap by a bound from the threshold, compared in full.

1. Usable vectors (no null, non-finite or all-zero ones) are normalised; equal vectors of a label are one node with a weight.
2. Nodes of a label (and of a length) are a shard. A shard above `limit` is split by centroids found on a bounded sample of it (SAMPLE
   nodes). A node is owned by the cell of its nearest centroid and is a guest of every cell that can own something within the
   threshold of it: of two linked nodes, none is further beyond the plane between their cells than r = sqrt(2 - 2 * threshold). So all
   links of a node lie in the one shard that owns it. A cell is split again while that is expected to halve the comparisons.
3. What a split cannot shrink (a ball of near copies, vectors without clusters) is cut into blocks by a hash, at most about
   BLOCK * limit nodes each, and all pairs of its blocks are compared: a task holds two blocks, whatever the shard's size.
4. Cosines are taken in double precision. Tasks report link counts of the nodes owned and a forest of links, never pairs.

The bound and the blocks leave nothing out; where clusters are missing, comparisons grow with the square of a label's size.

`audit_recall` holds the counts of the nodes whose id is divisible by `every` against a scan of all vectors;
`audited`, the registered path, does so for every result.

Defined results: null, empty, zero or non-finite vectors and vectors of a null label link with nothing and are their own component;
vectors of different lengths never link. Ties and repeated rows: equal vectors link with each other. Rows that repeat an id are
each counted. Other columns play no part; an empty table gives an empty result. Ids are integers; rows with a null id are left out.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, small_batches
from .components import components

log = logging.getLogger(__name__)

LEAST_RECALL = 0.95  # a result that the audit finds below it is not returned
SAMPLE = 512
BLOCK = 4  # a block of an unsplit shard holds about so many times the limit
LEVELS = 6  # of splitting; what is large after them is compared in blocks


def _centroids(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from a farthest-first start, the same for the same rows."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        at = np.argmax(x @ c.T, 1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(n > 0, sums / np.where(n > 0, n, 1), c)
    return c


def shards(nodes: DataFrame, limit: int, threshold: float) -> DataFrame:
    """nodes (node, label, v) with columns shard and own; a node has one row that is its own, and may be a guest in others."""
    r = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    at = nodes.select("node", "label", "v", F.xxhash64("label", F.size("v")).cast("string").alias("shard"), F.lit(True).alias("own"))
    schema = f"node long, label {nodes.schema['label'].dataType.simpleString()}, v array<double>, shard string, own boolean"

    def cells(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row, and all cells that the row belongs to."""
        s = x @ c.T
        home = np.argmax(s, 1)
        apart = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(2), 0))
        return home, s[np.arange(len(x)), home][:, None] - s <= r * apart[home]

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("r").v.to_numpy())
        own = pdf.sort_values("r").own.to_numpy(bool)
        c = _centroids(x, int(min(32, np.ceil(2 * pdf.n.iloc[0] / limit))))
        home, belongs = cells(x, c)
        pairs = np.bincount(home[own], minlength=len(c)) @ belongs.sum(0)
        if pairs > own.sum() * len(x) / 2:  # owned by all, before and after
            return pd.DataFrame({"shard": pd.Series([], dtype=str), "centres": pd.Series([], dtype=object)})
        return pd.DataFrame({"shard": [pdf.shard.iloc[0]], "centres": [c.ravel().tolist()]})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, own = b.column(0).to_pylist(), b.column(4).to_numpy(zero_copy_only=False)
            rows, to, owned = [], [], []
            for i in range(b.num_rows):
                v = b.column(3)[i].values.to_numpy()
                home, belongs = cells(v[None], b.column(5)[i].values.to_numpy().reshape(-1, len(v)))
                for k in np.flatnonzero(belongs[0]):
                    rows.append(i)
                    to.append(f"{names[i]}.{k}")
                    owned.append(bool(own[i] and k == home[0]))
            out = b.select([1, 2, 3]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(to, pa.string()), pa.array(owned, pa.bool_())], ["node", "label", "v", "shard", "own"])

    whole = []
    for _ in range(LEVELS):
        at = checkpoint(at)
        big = at.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > limit)
        w = Window.partitionBy("shard").orderBy(F.xxhash64("node"), "node")
        sample = at.join(big, "shard").withColumn("r", F.row_number().over(w)).where(F.col("r") <= SAMPLE)
        centres = checkpoint(sample.select("shard", "n", "r", "v", "own").groupBy("shard").applyInPandas(split, "shard string, centres array<double>"))
        whole.append(at.join(centres, "shard", "left_anti").select("node", "label", "v", "shard", "own"))
        at = at.join(centres, "shard").select("shard", "node", "label", "v", "own", "centres").mapInArrow(deal, schema)
        if centres.isEmpty():
            break
    else:
        whole.append(at)
    return reduce(DataFrame.union, whole)


def _join(low: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """low (the smallest row known to be reachable from each) after the links p - q."""
    while True:
        a, b = low[p], low[q]
        apart = a != b
        if not apart.any():
            return low
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while ((new := low[low]) != low).any():
            low = new


def compare(x: np.ndarray, weight: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row, and the smallest row reachable, by all pairs of a row in left and one in right of which one is owned. Left and
    right are the same rows or have none in common."""
    links, low = np.zeros(len(x), np.int64), np.arange(len(x))
    same = np.array_equal(left, right)
    y = x[right].T.copy()
    for a in range(0, len(left), 256):
        rows = left[a : a + 256]
        i, k = np.nonzero(x[rows] @ y >= threshold)
        p, q = rows[i], right[k]
        keep = (own[p] | own[q]) & (p != q)
        p, q = p[keep], q[keep]
        links += np.bincount(p, weight[q], len(x)).astype(np.int64)
        if not same:
            links += np.bincount(q, weight[p], len(x)).astype(np.int64)
        low = _join(low, p, q)
    return links, low


def embedding_dedup(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, limit: int = 1500
) -> DataFrame:
    """id_col, n_links, component_id, kept for every vector."""
    small_batches(vectors.sparkSession, 2000)
    v = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = checkpoint(v.withColumn("norm", F.when(sound, norm)).withColumn("ok", F.coalesce((F.col("norm") > 0) & (F.col("norm") < float("inf")), F.lit(False))))
    good = v.where("ok")
    classes = checkpoint(good.groupBy("label", "v").agg(F.min("id").alias("node"), F.count("*").alias("m"), F.first("norm").alias("norm")))
    nodes = classes.select("node", "label", F.transform("v", lambda x: x / F.col("norm")).alias("v"))
    at = checkpoint(shards(nodes, limit, threshold))
    sizes = at.groupBy("shard").agg(F.ceil(F.count("*") / (BLOCK * limit)).alias("blocks"), F.count_if("own").alias("owned")).where("owned > 0")
    at = at.join(sizes, "shard").join(classes.select("node", "m"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    at = at.select("shard", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "node", "v", "m", "own")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        ids, own = pdf.node.to_numpy(), pdf.own.to_numpy(bool)
        left, right = (np.flatnonzero((pdf.block == pdf[k]).to_numpy()) for k in ("a", "b"))
        links, low = compare(np.stack(pdf.v.to_numpy()), pdf.m.to_numpy(), own, left, right, threshold)
        says = own | (low != np.arange(len(low)))
        return pd.DataFrame({"node": ids, "links": np.where(own, links, 0), "low": ids[low]})[says]

    hits = checkpoint(at.groupBy("shard", "a", "b").applyInPandas(search, "node long, links long, low long"))
    comp = components(hits.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")))
    per_node = hits.groupBy("node").agg(F.sum("links").alias("links")).join(comp, "node", "left")
    per_class = classes.join(per_node, "node", "left").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = good.select("id", "label", "v").join(per_class, ["label", "v"]).select("id", "n_links", "component_id")
    alone = v.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def audit_recall(vectors: DataFrame, result: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, every: int = 100, queries: int = 2000) -> DataFrame:
    """One row: links that a scan of all vectors finds for the queries (all ids divisible by `every` that stand once), links found, and
    recall. The queries go to every task in blocks of about `queries`, one block after the other."""
    spark = vectors.sparkSession
    every_row = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    once = checkpoint(every_row.where(F.col("id") % every == 0).groupBy("id").agg(F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v")).where("n = 1 and label is not null and v is not null"))
    blocks = -(-once.count() // queries)
    links = result.select(F.col(id_col).cast("long").alias("id"), "n_links")
    true_links = found = 0
    for block in range(blocks):
        q = once.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toPandas()
        q = q[[len(v) > 0 and np.all(np.isfinite(np.asarray(v, float))) and 0 < np.linalg.norm(np.asarray(v, float)) < np.inf for v in q.v]]
        q["len"] = q.v.map(len)
        by = {k: (g["id"].to_numpy(np.int64), np.stack([np.asarray(v, float) / np.linalg.norm(np.asarray(v, float)) for v in g.v])) for k, g in q.groupby(["label", "len"])}

        def scan(batches: Iterator[pa.RecordBatch], by=by) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits = []
                for i, k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    if v and (k, len(v)) in by and None not in v and np.isfinite(v).all() and 0 < (n := np.linalg.norm(v)) < np.inf:
                        ids, x = by[k, len(v)]
                        hits.append(ids[(x @ (np.asarray(v) / n) >= threshold) & (ids != i)])
                if hits:
                    ids, n = np.unique(np.concatenate(hits), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"id": pa.array(ids.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

        true = every_row.where("id is not null").mapInArrow(scan, "id long, n long").groupBy("id").agg(F.sum("n").alias("true_links"))
        r = true.join(links, "id").agg(F.sum("true_links").alias("t"), F.sum(F.least("n_links", "true_links")).alias("f")).collect()[0]
        true_links, found = true_links + (r.t or 0), found + (r.f or 0)
    return spark.createDataFrame([(true_links, found, found / true_links if true_links else 1.0)], "true_links long, found long, recall double")


def audited(vectors: DataFrame) -> DataFrame:
    """embedding_dedup by the default columns, held against a scan for every hundredth id before it is returned."""
    out = checkpoint(embedding_dedup(vectors))
    row = audit_recall(vectors, out).collect()[0]
    log.info("recall %.6f: %d of %d links of the audited ids", row.recall, row.found, row.true_links)
    if row.recall < LEAST_RECALL:
        raise RuntimeError(f"embedding_dedup found {row.found} of {row.true_links} links of the audited ids")
    return out
