"""A stated set of rows (queries) against all rows of a table, block by block.

Both sides are packed into rows of bounded size, and the packed rows are joined without a condition: Spark tells the smaller side to all
tasks while its statistics are below the broadcast threshold, and else pairs partitions, so neither side has to fit anywhere. The table
is read once, whatever the number of queries, and nothing runs before the result is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS, ASKED = 4096, 1024  # rows of a packed row


def _told(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as out:
        for b in batches:
            out.write_batch(b)
    return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["payload"])


def _read(payload: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(payload.as_buffer()).read_all()


HELD = 1 << 16  # rows that a task holds while it packs by key


def packed(df: DataFrame, most: int, key: str | None = None) -> DataFrame:
    """(payload): the rows of df, up to `most` to a row. With a key, its first column, (key, payload): rows of one key each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        n = 0

        def told(k) -> pa.RecordBatch:  # noqa: ANN001
            out = _told(held.pop(k)[0])
            return out if key is None else pa.RecordBatch.from_arrays([pa.array([k], kind), out.column(0)], [key, "payload"])

        for batch in batches:
            kind = batch.schema[0].type
            parts = [(None, batch)]
            if key is not None:
                codes = batch.column(0).dictionary_encode()
                order = pc.array_sort_indices(codes.indices)
                ends = np.cumsum([0, *np.bincount(codes.indices.to_numpy(), minlength=len(codes.dictionary))])
                parts = [(k, batch.take(order[a : b])) for k, a, b in zip(codes.dictionary.to_pylist(), ends[:-1], ends[1:])]
            for k, part in parts:
                for at in range(0, part.num_rows, most):
                    b = part.slice(at, most)
                    if k in held and held[k][1] + b.num_rows > most:
                        n -= held[k][1]
                        yield told(k)
                    rows, size = held.setdefault(k, ([], 0))
                    held[k] = ([*rows, b], size + b.num_rows)
                    n += b.num_rows
            if n > HELD:
                for k in list(held):
                    yield told(k)
                n = 0
        for k in list(held):
            yield told(k)

    if key is None:
        return df.mapInArrow(pack, "payload binary")
    return df.mapInArrow(pack, f"{key} {df.schema[key].dataType.simpleString()}, payload binary")


def against(
    rows: DataFrame, asked: DataFrame, score: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str, *, most: int = ROWS, most_asked: int = ASKED, key: str | None = None
) -> DataFrame:
    """score(block of rows, block of asked rows) for all pairs of blocks; with a key, the first column of both, for those of equal keys."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left, held, n = None, None, [], 0
        for b in batches:
            for place, mine, theirs in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                right = _read(theirs)
                if held and (place != at or n + right.num_rows > most_asked):
                    yield from score(left, pa.concat_tables(held).combine_chunks())
                    held, n = [], 0
                if place != at:
                    at, left = place, _read(mine).combine_chunks()
                held.append(right)
                n += right.num_rows
        if held:
            yield from score(left, pa.concat_tables(held).combine_chunks())

    keys = [] if key is None else [key]
    mine = packed(rows, most, key).select(*keys, F.monotonically_increasing_id().alias("place"), F.col("payload").alias("rows"))
    theirs = packed(asked, most_asked, key)
    pairs = mine.crossJoin(theirs) if key is None else mine.join(theirs, key)
    return pairs.select("place", "rows", "payload").mapInArrow(scored, schema)
