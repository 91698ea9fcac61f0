"""Mixing sources to target weights by Pfair scheduling.

Time is counted in slots of one block each. Block i of a source with weight w is released at slot floor(i / w) and due by
ceil((i + 1) / w); in every slot the released block with the earliest deadline goes. At no point has a source had a block more or less
than its weight's share of the slots so far. Weights are fractions, exact as they are written, and nothing is rounded or repeated: the
schedule runs on the driver from the first slot to the last, one slot a block, and is written down in bounded stretches. The driver holds
one entry a source.

Every document is used at least once: a source that runs out starts again (the next epoch) until the slowest one is through, so
weights hold to the end and nothing is dropped. Within a source, documents go in the order of a seeded hash of their rows.

Rows are numbered in buckets of a source, dealt by that hash, plus the bucket's offset: a source of a third of all rows is many
buckets, and so are a third of rows with one id. Defined results: a null source is a source of its own; null ids hash like a value;
repeated rows are rows; other columns, of any name, are kept. An empty table gives an empty result. Weights for sources that hold no row are dropped.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir

ROWS_PER_BUCKET = 1024
STRETCH = 250  # periods that are written down at a time
TOLD = 250_000  # slots, and sources, up to which all tasks are told of them


def shares(weights: Mapping, period: int) -> dict:
    """Integer shares of the period, at least 1 each, by largest remainders; ties by the source's name."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources do not fit a period of {period} slots")
    total = sum(weights.values())
    if total <= 0 or min(weights.values()) < 0:
        raise ValueError("weights must be positive")
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    by_need = sorted(exact, key=lambda s: (out[s] - exact[s], str(s)))
    i = 0
    while (d := period - sum(out.values())) != 0:
        s = by_need[i % len(by_need)] if d > 0 else max(out, key=lambda s: (out[s] - exact[s], out[s], str(s)))
        out[s] += 1 if d > 0 else -1
        i += 1
    return out


def exact(weights: Mapping) -> dict:
    """The weights as fractions of their sum; floats count as they are written."""
    w = {s: Fraction(x) if isinstance(x, (int, Fraction)) else Fraction(repr(float(x))) for s, x in weights.items()}
    total = sum(w.values())
    if w and (total <= 0 or min(w.values()) <= 0):
        raise ValueError("weights must be positive")
    return {s: x / total for s, x in w.items()}


def slots(weights: Mapping) -> Iterator:
    """The source of every slot, without end."""
    w = exact(weights)
    names = sorted(w, key=lambda s: (s is not None, str(s)))
    up, down = [w[s].numerator for s in names], [w[s].denominator for s in names]
    waiting = [(0, k, 0) for k in range(len(names))]  # release, source, block
    ready: list = []
    slot = 0
    while names:
        while waiting and waiting[0][0] <= slot:
            _, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * down[k] // up[k]), k, i))
        _, k, i = heapq.heappop(ready)
        heapq.heappush(waiting, ((i + 1) * down[k] // up[k], k, i + 1))
        yield names[k]
        slot += 1


def schedule(share: Mapping) -> list:
    """The source of every slot of one period of integer shares."""
    return list(islice(slots(share), sum(share.values())))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    *,
    source_col: str = "source",
    id_col: str = "doc_id",
    block: int = 16,
    period: int = 1000,
    uniform: float = 0.2,
    seed: int = 17,
    into: tuple[str, str] = ("mix_position", "mix_epoch"),
) -> DataFrame:
    """The rows of docs with their place in the mix and the epoch of their source. Without weights: each source's share of the rows,
    blended with `uniform` parts of equal shares. The schedule is written down in stretches of STRETCH * period slots."""
    spark = docs.sparkSession
    pos, epoch = into
    tag = "_" + "_".join([*docs.columns, *into])  # prefix of our own columns: longer than any of theirs
    c = lambda name: tag + name
    hashed = [f.name for f in docs.schema if f.name != id_col and not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    h = F.xxhash64(F.lit(seed), F.col(id_col), *[F.col(f"`{x}`") for x in hashed])
    n = {r[0]: r[1] for r in docs.groupBy(source_col).agg(F.count("*").alias("n")).collect()}  # one row a source
    total = sum(n.values())
    if weights is None:
        part = Fraction(repr(float(uniform)))
        weights = {s: (1 - part) * k / total + part / len(n) for s, k in n.items()}
    missing = [s for s in n if not weights.get(s)]
    if missing:
        raise ValueError(f"no weight for the sources {missing[:5]}: leave them out of the input, or give them one")
    of = {s: i for i, s in enumerate(sorted(n, key=lambda s: (s is not None, str(s))))}
    path = f"{shared_dir(spark)}/lodestream/{uuid.uuid4().hex}"
    kinds = f"{c('k')} int, {c('blk')} long, {c('at')} long"
    order, used, wanted = slots({s: weights[s] for s in n}), dict.fromkeys(n, 0), {s: -(-k // block) for s, k in n.items()}
    open_, end = len(n), 0
    while open_:  # until every source has had all its blocks
        k, blk = [], []
        for s in islice(order, STRETCH * period):
            k.append(of[s])
            blk.append(used[s])
            used[s] += 1
            open_ -= used[s] == wanted[s]
            if not open_:
                break
        stretch = pa.table({c("k"): pa.array(k, pa.int32()), c("blk"): pa.array(blk, pa.int64()), c("at"): pa.array(range(end, end + len(k)), pa.int64())})
        spark.createDataFrame(stretch, kinds).write.mode("append").parquet(path)
        end += len(k)
    table = spark.read.schema(kinds).parquet(path) if end else spark.createDataFrame([], kinds)
    table = F.broadcast(table) if end <= TOLD else table
    sources = [(s, i, n[s], -(-used[s] * block // n[s]), max(1, -(-n[s] // ROWS_PER_BUCKET))) for s, i in of.items()]
    kind = docs.schema[source_col].dataType.simpleString()
    info = spark.createDataFrame(sources, f"{c('s')} {kind}, {c('k')} int, {c('n')} long, {c('epochs')} long, {c('buckets')} long")
    info = F.broadcast(info) if len(n) <= TOLD else info

    def bucketed(df: DataFrame) -> DataFrame:
        return df.join(info, F.col(source_col).eqNullSafe(F.col(c("s")))).withColumn(c("b"), F.pmod(F.col(c("h")), F.col(c("buckets"))))

    known = bucketed(docs.withColumn(c("h"), h))
    sizes = bucketed(docs.select(source_col, h.alias(c("h")))).groupBy(c("k"), c("b")).agg(F.count("*").alias(c("m")))
    w = Window.partitionBy(c("k")).orderBy(c("b"))  # one row a bucket
    offsets = sizes.withColumn(c("off"), F.sum(c("m")).over(w) - F.col(c("m"))).select(c("k"), c("b"), c("off"))
    own: Column = F.row_number().over(Window.partitionBy(c("k"), c("b")).orderBy(c("h"), id_col)) - 1
    numbered = known.withColumn(c("rn"), own).join(offsets, [c("k"), c("b")])
    each = numbered.withColumn(epoch, F.explode(F.sequence(F.lit(0).cast("long"), F.col(c("epochs")) - 1)))
    row = F.col(epoch) * F.col(c("n")) + F.col(c("off")) + F.col(c("rn"))
    each = each.withColumn(c("row"), row).withColumn(c("blk"), F.expr(f"`{c('row')}` div {block}")).join(table, [c("k"), c("blk")])
    return each.select(*[F.col(f"`{x}`") for x in docs.columns], (F.col(c("at")) * block + F.col(c("row")) % block).alias(pos), epoch)
