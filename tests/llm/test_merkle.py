import hashlib
import random

import pytest
from lodestream.llm.merkle import folded_root, leaf_digest, merkle_manifest, proof_digest
from pyspark.sql import functions as F


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, arity):
    """Level by level: the root, and for each node its siblings as (left, right)."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = a // arity * arity
            paths[i].append(("".join(nodes[run:a]), "".join(nodes[a + 1 : run + arity])))
        nodes = [h(*nodes[k : k + arity]) for k in range(0, len(nodes), arity)]
        at = [a // arity for a in at]
    return nodes[0], paths


def brute(rows, arity):
    """rows (id, lang, text) to sorted (id, leaf, path, subroot, root)."""
    runs = {}
    for i, lang, text in rows:
        runs.setdefault("" if lang is None else f"={lang}", []).append(((i is not None, i or 0), leaf(i, text)))
    subs = {k: tree([x for _, x in sorted(v)], arity) for k, v in runs.items()}
    order = sorted(subs, key=lambda k: k.encode())
    root, above = tree([subs[k][0] for k in order], arity)
    out = []
    for k, up in zip(order, above):
        for ((_, i), x), path in zip(sorted(runs[k]), subs[k][1]):
            out.append((str(i), x, (*path, *up), subs[k][0], root))
    return sorted(out)


def ours(spark, rows, arity, depth):
    df = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], "doc_id long, lang string, text string, path string, pos int, n int").repartition(3)
    df = df.withColumn("leaf", leaf_digest(F.col("doc_id"), F.col("text")))
    out = merkle_manifest(df.drop("path"), group="lang", order="doc_id", arity=arity, depth=depth)
    got = out.withColumn("proof", proof_digest(F.col("path"))).withColumn("folded", folded_root(F.col("leaf"), F.col("path"))).collect()
    assert all(r.folded == r.root and r.proof == h(*(x.left + x.right for x in r.path)) and r.pos == 1 and r.n == 2 for r in got)
    return sorted((str(r.doc_id or 0), r.leaf, tuple((x.left, x.right) for x in r.path), r.subroot, r.root) for r in got)


@pytest.mark.parametrize("arity, depth", [(2, 1), (2, 2), (3, 2), (2, 10)])
def test_equals_levels(spark, arity, depth):
    r = random.Random(arity * 10 + depth)
    langs = [None, "a", "é", "zz", "Z", "", "-"]
    for sizes in ([33, 1, 2, 5, 0, 1, 3], [0, 9, 0, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0, 0]):
        rows = [(r.randrange(10**6), lang, r.choice([None, "", "text", "ü" * 50])) for lang, n in zip(langs, sizes) for _ in range(n)]
        assert ours(spark, rows, arity, depth) == brute(rows, arity)


def test_ties_nulls_and_long_texts(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (1, "a", "y"), (None, "a", "x"), (None, None, None), (5, "a", "long " * 400_000)]
    want = [(i if i != "None" else "0", *x) for i, *x in brute(rows, 2)]
    assert ours(spark, rows, 2, 2) == sorted(want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, lang string, leaf string")
    out = merkle_manifest(df, group="lang", order="doc_id")
    assert out.columns == ["doc_id", "lang", "leaf", "path", "subroot", "root"] and out.count() == 0


def test_any_change_breaks_the_fold(spark):
    rows = [(i, "ab"[i % 2], str(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("leaf", leaf_digest(F.col("doc_id"), F.col("text")))
    out = merkle_manifest(df, group="lang", order="doc_id", depth=2)
    bad = folded_root(leaf_digest(F.col("doc_id"), F.concat("text", F.lit("!"))), F.col("path"))
    assert out.where(bad == F.col("root")).count() == 0
    assert out.join(out.select(F.col("doc_id").alias("d"), F.col("path").alias("other")), F.col("d") == F.col("doc_id") + 1).where(folded_root(F.col("leaf"), F.col("other")) == F.col("root")).count() == 0


def test_null_group_comes_first(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y")], "doc_id long, lang string, text string").withColumn("leaf", leaf_digest(F.col("text")))
    out = {r.doc_id: r for r in merkle_manifest(df, group="lang", order="doc_id").collect()}
    assert out[1].root == h(leaf("x"), leaf("y")) and out[1].path[0].left == "" and out[2].path[0].right == ""
