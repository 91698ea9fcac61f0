"""Merkle manifest of a dataset: a digest for every row, a root for every group of rows and for all, and a proof for every row.

A row is a leaf. The leaves of a run (the rows of one group) ascend by id; while a run has several nodes, every `arity` consecutive ones
become their digest, a last incomplete set included, even one alone. What remains is the run's subroot; the subroots, ordered by group,
give the root in the same way.

Positions come from a range sort and a prefix sum over the counts of its partitions. Runs are cut into aligned blocks of
arity ** depth leaves. One recursion traverses a block in postorder: it returns the subtree's digest and, while it unwinds, appends the
siblings to the leaves that the subtree holds. The blocks' digests are the nodes of the next, smaller traversal, until every run is one
block; the paths are then handed down the same way. Only digests and ids are shuffled, never texts, and no group is larger than a block.

Defined results: a null value counts as `-`, which no value does; null groups are a run of their own, before all others; null ids come
first in their run, rows of one id in the order of their leaves. A run of one row has its leaf as subroot and no siblings below it. An
empty table has an empty manifest. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

ARITY, DEPTH = 2, 10
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """SHA-256 over the values, each as its length in UTF-8 bytes, a colon and itself, or `-`."""
    told = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in told)).cast("binary"), 256)


def folded_root(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 over the siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "").cast("binary"), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (run, ...) with pos, the place in the run from 0, and n, the run's size. Equal rows may take each other's places."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = ["run", *order]
    placed = rows.repartitionByRange(n, *sort).sortWithinPartitions(*sort)
    placed = checkpoint(placed.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    parts = placed.groupBy("run", "part").agg(F.min("at").alias("first"), F.count("*").alias("c"))  # a row a run and partition
    run = Window.partitionBy("run")
    before = F.coalesce(F.sum("c").over(run.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("run", "part", (before - F.col("first")).alias("shift"), F.sum("c").over(run).alias("n"))
    return placed.join(parts, ["run", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def traverse(nodes: Sequence[str], height: int, arity: int, lefts: list[list[str]], rights: list[list[str]], lo: int = 0) -> str:
    """The digest of the subtree of this height over the nodes from lo on; their siblings below its root are appended to their lists."""
    if height == 0:
        return nodes[lo]
    step = arity ** (height - 1)
    starts = range(lo, min(lo + step * arity, len(nodes)), step)
    tops = [traverse(nodes, height - 1, arity, lefts, rights, a) for a in starts]
    for j, a in enumerate(starts):
        left, right = "".join(tops[:j]), "".join(tops[j + 1 :])
        for leaf in range(a, min(a + step, len(nodes))):
            lefts[leaf].append(left)
            rights[leaf].append(right)
    return digest("".join(tops))


def block_paths(block: pa.Table, arity: int, depth: int) -> tuple[pa.Table, str, list[list[str]], list[list[str]]]:
    """A block's nodes in order, the digest of its subtree, and the siblings of every node inside it."""
    block = block.sort_by("pos")
    n, size = block.column("n")[0].as_py(), arity**depth
    height = depth if n > size else next(h for h in range(depth + 1) if arity**h >= n)
    lefts, rights = [[] for _ in range(block.num_rows)], [[] for _ in range(block.num_rows)]
    return block, traverse(block.column("node").to_pylist(), height, arity, lefts, rights), lefts, rights


def block_roots(nodes: DataFrame, arity: int, depth: int) -> DataFrame:
    """The nodes of the next traversal: run, pos (of the block), n, node."""
    size = arity**depth

    def root(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        _, top, _, _ = block_paths(block, arity, depth)
        n = -(-block.column("n")[0].as_py() // size)
        return pa.table({"run": pa.array([key[0].as_py()], pa.string()), "pos": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([n], pa.int64()), "node": pa.array([top], pa.string())})

    by = nodes.select("run", "pos", "n", "node").withColumn("block", F.floor(F.col("pos") / size)).groupBy("run", "block")
    return by.applyInArrow(root, "run string, pos long, n long, node string")


def with_paths(nodes: DataFrame, above: DataFrame | None, arity: int, depth: int) -> DataFrame:
    """nodes with path, subroot and root. above: run, pos (of a block), path, subroot, root; without it, blocks are whole trees."""

    def down(block: pa.Table, up: pa.Table | None) -> pa.Table:
        block, top, lefts, rights = block_paths(block.drop_columns(["block"]), arity, depth)
        more = up.column("path")[0].as_py() if up else []
        ends, left, right = [0], [], []
        for a, b in zip(lefts, rights):
            left += [*a, *(x["left"] for x in more)]
            right += [*b, *(x["right"] for x in more)]
            ends.append(len(left))
        path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"]))
        tops = [up.column(c)[0].as_py() if up else top for c in ("subroot", "root")]
        out = block.append_column("path", path)
        for name, value in zip(("subroot", "root"), tops):
            out = out.append_column(name, pa.array([value] * block.num_rows, pa.string()))
        return out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    schema = f"{kinds}, path array<struct<left: string, right: string>>, subroot string, root string"
    by = nodes.withColumn("block", F.floor(F.col("pos") / arity**depth)).groupBy("run", "block")
    if above is None:
        return by.applyInArrow(lambda block: down(block, None), schema)
    return by.cogroup(above.select("run", "pos", "path", "subroot", "root").groupBy("run", "pos")).applyInArrow(down, schema)


def levels(nodes: DataFrame, arity: int, depth: int) -> list[DataFrame]:
    """The nodes, the roots of their blocks, the roots of those and so on, to the roots of the runs."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    out = [nodes, checkpoint(block_roots(nodes, arity, depth))]
    while most > arity**depth:
        most = -(-most // arity**depth)
        out.append(checkpoint(block_roots(out[-1], arity, depth)))
    return out


def merkle_manifest(rows: DataFrame, *, group: str, order: str, leaf: str = "leaf", arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
    """rows (with the digests `leaf`) with path (siblings to the left and right of every level, joined), subroot and root.

    path folds from the leaf over the run's levels and those of the subroots to the root: `folded_root`.
    """
    plain = {c: f"c{k}" for k, c in enumerate(rows.columns)}  # the names of the caller's columns meet none of these here
    run = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null before all
    told = rows.select(run.alias("run"), F.col(leaf).alias("node"), *(F.col(c).alias(a) for c, a in plain.items()))
    nodes = numbered(checkpoint(told), [plain[order], "node"])
    tree = levels(checkpoint(nodes), arity, depth)
    tops = numbered(tree.pop().select(F.lit("").alias("run"), F.col("run").alias("of"), "node"), ["of"])
    forest = levels(checkpoint(tops), arity, depth)[:-1]
    above = None
    for k in reversed(forest):
        above = with_paths(k, above, arity, depth)
    above = checkpoint(above.select(F.col("of").alias("run"), F.lit(0).cast("long").alias("pos"), "path", F.col("node").alias("subroot"), "root"))
    for k in reversed(tree):
        above = with_paths(k, above, arity, depth)
    return above.select(*(F.col(a).alias(c) for c, a in plain.items()), "path", "subroot", "root")
