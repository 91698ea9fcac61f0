"""Near-duplicates of a whole corpus by the sequential rule: in order, a row stays unless an earlier row that stays is near it.

Candidates come from lossless keys. Of m bands of a fingerprint, at most `limit` differ between near rows, so m - limit are equal: every
choice of that many bands is a key. Rows of one fingerprint are one node, with its first row. Then the rule is applied in rounds over the
pairs: who has no undecided earlier neighbour stays, who is near one that stays goes. The result is that of the sequential pass; no
group of rows is ever in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import table_of


def pairs_of(nodes: DataFrame, keys: Column, near: Callable[[str, str], Column], first: Callable[[str, str], Column]) -> DataFrame:
    """(a, b), a before b, of nodes (node, fingerprint) that share a key and are near. keys: as many for each node, each held against its
    like. first: the place of the first key that two fingerprints share; the pair comes from that one alone."""
    each = table_of(nodes.select("node", F.posexplode(keys).alias("place", "key")))
    twice = each.groupBy("place", "key").agg(F.count("*").alias("c")).where("c > 1").select("place", "key")
    each = each.join(twice, ["place", "key"], "left_semi").join(nodes.select("node", "fingerprint"), "node")
    x, y = (each.select("place", "key", F.col("node").alias(n), F.col("fingerprint").alias(f)) for n, f in (("a", "x"), ("b", "y")))
    return x.join(y, ["place", "key"]).where((F.col("a") < F.col("b")) & near("x", "y") & (first("x", "y") == F.col("place"))).select("a", "b")


def stays(pairs: DataFrame) -> DataFrame:
    """(node, kept_as) of the nodes that go: the first node that stays and is near them. The others stay."""
    pairs = table_of(pairs)
    open_, gone = pairs, []
    while not open_.isEmpty():
        waiting = open_.select(F.col("b").alias("a")).distinct()  # nodes with an undecided earlier neighbour
        gone.append(table_of(open_.join(waiting, "a", "left_anti").select("b").distinct()))  # near one that stays
        open_ = table_of(open_.join(gone[-1], "b", "left_anti").join(gone[-1].select(F.col("b").alias("a")), "a", "left_anti"))
    if gone:  # whoever never goes stays
        pairs = pairs.join(reduce(DataFrame.union, gone).select(F.col("b").alias("a")), "a", "left_anti")
    return pairs.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("kept_as"))


def _greedy(rows: DataFrame, key: str, keys: Column, near: Callable[[str, str], Column], first: Callable[[str, str], Column]) -> DataFrame:
    """rows (key, fingerprint): (key, kept_as)."""
    rows = table_of(rows)  # what made them is run once
    nodes = table_of(rows.groupBy("fingerprint").agg(F.min(key).alias("node")))
    goes = stays(pairs_of(nodes, keys, near, first))
    of = nodes.join(goes, "node", "left").select("fingerprint", F.coalesce("kept_as", "node").alias("kept_as"))
    return rows.join(of, "fingerprint").select(key, "kept_as")


def greedy_simhash(fingerprints: DataFrame, key: str = "doc_id", limit: int = 3) -> DataFrame:
    """(key, kept_as) of fingerprints (key, hi, lo), two halves of 32 bits: kept_as is the row's own key where it stays."""
    m = limit + 3
    cuts = [64 * i // m for i in range(m + 1)]
    choices = list(combinations(range(m), m - limit))

    def bands(of: str) -> list[Column]:
        word = F.shiftleft(F.col(f"{of}.hi"), 32).bitwiseOR(F.col(f"{of}.lo"))
        return [F.shiftrightunsigned(F.shiftleft(word, 64 - b), 64 - b + a) for a, b in zip(cuts, cuts[1:])]

    def first(x: str, y: str) -> Column:
        equal = sum((F.when(p == q, 1 << j).otherwise(0) for j, (p, q) in enumerate(zip(bands(x), bands(y)))), F.lit(0))
        places = [next((i for i, c in enumerate(choices) if all(e >> j & 1 for j in c)), -1) for e in range(1 << m)]
        return F.get(F.array(*map(F.lit, places)), equal)

    own = bands("fingerprint")
    keys = F.array(*[F.xxhash64(F.lit(i), *[own[j] for j in c]) for i, c in enumerate(choices)])
    apart = lambda x, y: sum((F.bit_count(F.col(f"{x}.{h}").bitwiseXOR(F.col(f"{y}.{h}"))) for h in ("hi", "lo")), F.lit(0))
    return _greedy(fingerprints.select(key, F.struct("hi", "lo").alias("fingerprint")), key, keys, lambda x, y: apart(x, y) <= limit, first)


def greedy_minhash(signatures: DataFrame, key: str = "doc_id", threshold: float = 0.8, seeds: int = 128) -> DataFrame:
    """The same of signatures (key, signature) whose share of equal places is at least the threshold: of one band more than places may
    differ, one is equal."""
    least = next(n for n in range(seeds + 1) if n / seeds >= threshold)
    m = seeds - least + 1
    cuts = [seeds * i // m for i in range(m + 1)]
    bands = lambda of: [F.slice(of, a + 1, b - a) for a, b in zip(cuts, cuts[1:])]
    keys = F.array(*[F.xxhash64(F.lit(i), band) for i, band in enumerate(bands("fingerprint"))])
    first = lambda x, y: F.array_position(F.array(*[p == q for p, q in zip(bands(x), bands(y))]), True) - 1
    same = lambda x, y: F.aggregate(F.zip_with(F.col(x), F.col(y), lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, v: s + v)
    return _greedy(signatures.select(key, F.col("signature").alias("fingerprint")), key, keys, lambda x, y: same(x, y) >= least, first)
