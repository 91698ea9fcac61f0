"""SentencePiece encoding and decoding as a relational lattice.

A text is cut into units where no piece of the model can cross: between two characters that stand side by side in no piece. Distinct
units are exploded into their substrings of bounded length, equi-joined to the piece table, and the matches, grouped by unit, are the
edges of its lattice. A fold over the edges then segments the unit:

* unigram models: Viterbi, edges by end, keeping the best score and last piece of every prefix;
* BPE models, whose scores are merge ranks and no likelihoods, so that Viterbi would not give the model's segmentation: edges by rank,
  each merged if exactly two tokens of the present segmentation make it up. Should a merge allow one of better rank, which this order
  has passed, the unit goes to an exact priority queue over the same edges, and so do units of more than 60 characters.

Texts are then written once as blocks of word numbers: a block has its distinct words as runs of unit numbers. Units up to a bounded
number of the most frequent ones are told to all tasks; a block carries the list of its other units, which are joined to the dictionary
by unit and brought back to their block. The blocks' table is bucketed by block, so the texts themselves are never shuffled.

Defined results: null text gives null ids, empty text no ids. Characters that no piece has are given as bytes if the model has byte
pieces, else as the unknown id. Special tokens in a text are ordinary text. Decoding gives back the text as the model normalises it
(for the identity normaliser: the text itself, but for the word mark, which decodes as a space). Repeated rows are rows; null ids and
any other columns play no part. An empty table gives an empty result. Only models with the identity normaliser, a dummy prefix and
kept white space are taken; others raise ValueError.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, checkpoint, give_back, settings, small_batches

MARK = "▁"
FREQUENT = 1 << 19  # units told to all tasks, of at most LONGEST characters each
STRETCH = 1 << 18  # words whose ids are put together at once
BLOCK_BYTES = 4 << 20  # of the texts that travel as one row; a single longer text is a block of its own
COUNT_BYTES = 4 << 20  # of the texts whose units are counted together
LONGEST = 60  # characters of a unit whose cuts fit into 64 bits
LONGEST_VITERBI = 256  # characters of a unit whose prefixes are folded as an array
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) pairs of a protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        v = shift = 0
        while True:
            c = b[i]
            i += 1
            v |= (c & 127) << shift
            shift += 7
            if c < 128:
                return v

    while i < len(b):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, b[i : i + n]
            i += n


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]  # piece, score, type; the place is the id
    bpe: bool
    unknown: int
    byte_ids: list[int] | None

    @classmethod
    def read(cls, raw: bytes) -> Model:
        pieces, trainer, normal = [], {}, {}
        for f, v in _fields(raw):
            if f == 1:
                d = dict(_fields(v))
                pieces.append((d.get(1, b"").decode(), struct.unpack("<f", d.get(2, bytes(4)))[0], d.get(3, NORMAL)))
            elif f == 2:
                trainer = dict(_fields(v))
            elif f == 3:
                normal = dict(_fields(v))
        if normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(3, 1) not in (1, 2) or trainer.get(24, 0):
            raise ValueError("only unigram and BPE models with the identity normaliser, a dummy prefix and kept white space")
        if any(t == USER for _, _, t in pieces):
            raise ValueError("user-defined pieces are not taken")
        byte = {p: i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        return cls(pieces, trainer.get(3, 1) == 2, next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN), [byte[f"<0x{k:02X}>"] for k in range(256)] if byte else None)

    def normal(self) -> list[tuple[str, int, float]]:
        return [(p, i, s) for i, (p, s, t) in enumerate(self.pieces) if t == NORMAL]

    def decode(self, ids: np.ndarray) -> str:
        return self.decoder()(ids)

    def raw(self) -> list[bytes]:
        """What each id decodes to."""
        return [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(MARK, " ").encode() for p, _, t in self.pieces]

    def decoder(self):
        raw = self.raw()

        def decode(ids) -> str:
            out = b"".join([raw[i] for i in ids])
            return out[out.startswith(b" ") :].decode("utf-8", "replace")

        return decode


WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Cutter:
    """Cuts texts into words and words into units: no piece crosses from one to the next."""

    def __init__(self, model: Model) -> None:
        pieces = [p for p, _, _ in model.normal()]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece holds a word mark inside")
        inner = sorted({c for p in pieces if len(p) > 1 for c in p})
        self.kind = np.zeros(0x110000, np.uint16)  # 0: never beside another character in a piece
        self.kind[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.joined = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        for p in pieces:
            for a, b in zip(p, p[1:]):
                self.joined[self.kind[ord(a)], self.kind[ord(b)]] = True
        if not model.bpe and not model.byte_ids:  # a run of characters without a piece is one unknown id
            single = {p for p in pieces if len(p) == 1}
            lone = np.array([True] + [c not in single for c in inner])
            self.joined |= np.outer(lone, lone)

    @staticmethod
    def words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Row numbers of the texts in another order, offsets of their words, and the words: each stands for a mark and itself."""
        text = pc.fill_null(text.cast(pa.large_string()), "")
        odd = pc.or_(pc.match_substring(text, "  "), pc.match_substring(text, MARK))
        for test in (pc.starts_with(text, " "), pc.ends_with(text, " "), pc.equal(text, "")):
            odd = pc.or_(odd, test)
        odd = odd.to_numpy(zero_copy_only=False)
        plain = pc.split_pattern(text.filter(pa.array(~odd)), " ")
        rest = [[w[1:] for w in WORD.findall(MARK + x.replace(" ", MARK))] if x else [] for x in text.filter(pa.array(odd)).to_pylist()]
        sizes = np.concatenate([np.diff(plain.offsets.to_numpy()), np.array([len(x) for x in rest], np.int64)])
        words = plain.flatten()
        if rest:
            words = pa.concat_arrays([words, pa.array([w for x in rest for w in x], pa.large_string())])
        return np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]), np.concatenate([[0], np.cumsum(sizes)]), words

    def units(self, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Offsets of the units of each word, and the units."""
        marked = pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), words, pa.scalar("", pa.large_string()))
        if not len(marked):
            return np.zeros(1, np.int64), marked
        at = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset : marked.offset + len(marked) + 1]
        data = marked.buffers()[2].slice(at[0], at[-1] - at[0])
        codes = np.frombuffer(data.to_pybytes().decode().encode("utf-32-le"), np.uint32)
        first = np.concatenate([[0], np.cumsum(pc.utf8_length(marked).to_numpy())])
        width = np.ones(len(codes), np.int8)  # bytes of each character
        for least in (0x80, 0x800, 0x10000):
            width += codes >= least
        kind = self.kind[codes]
        del codes
        cut = np.ones(len(kind) + 1, bool)
        cut[1:-1] = ~self.joined[kind[:-1], kind[1:]]
        cut[first] = True
        cuts = np.flatnonzero(cut)
        byte = np.zeros(len(width) + 1, np.int64)
        np.cumsum(width, out=byte[1:])
        byte = byte[cuts]
        return np.searchsorted(cuts, first), pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(byte), data)


def blocks(batches: Iterator[pa.RecordBatch], text: int, size_of: int) -> Iterator[pa.RecordBatch]:
    """The batches put together to blocks of so many bytes of text. What a block took is given back before the next, and after the last."""
    held, size = [], 0
    give_back()  # what the worker's tasks before took
    for b in batches:
        if held and size + b.column(text).nbytes > size_of:
            block, held, size = pa.Table.from_batches(held).combine_chunks().to_batches()[0], [], 0
            yield block
            del block
            give_back()
        if b.num_rows:
            held.append(b)
            size += b.column(text).nbytes
    if held:
        block, held = pa.Table.from_batches(held).combine_chunks().to_batches()[0], []
        yield block
        del block
    give_back()


def gathered(flat: np.ndarray, off: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[off[i]:off[i + 1]] of every i of index, one after another, and their offsets."""
    size = off[index + 1] - off[index]
    out = np.concatenate([[0], np.cumsum(size)])
    return flat[np.arange(out[-1]) + np.repeat(off[index] - out[:-1], size)], out


def planes(numbers: np.ndarray) -> dict[str, np.ndarray]:
    """The four bytes of each number apart, so that they compress."""
    parts = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4)
    return {f"word{i}": np.ascontiguousarray(parts[:, i]) for i in range(4)}


def from_planes(col: dict[str, pa.Array]) -> np.ndarray:
    return np.stack([col[f"word{i}"].to_numpy() for i in range(4)], axis=1).reshape(-1).view("<u4").astype(np.int64)


def by_frequency(numbers: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers with the most frequent one as 0, the next as 1 and so on, and the old number of each new one."""
    order = np.argsort(-np.bincount(numbers, minlength=kinds), kind="stable")
    new = np.empty(kinds, np.uint32)
    new[order] = np.arange(kinds, dtype=np.uint32)
    return new[numbers], order


def one_row(arrays: dict[str, pa.Array | np.ndarray]) -> bytes:
    """Arrays of any lengths as one compressed row of lists."""
    lists = {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v)) for k, v in arrays.items()}
    batch = pa.RecordBatch.from_pydict(lists)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """piece, id, score, rank, risky: whether a piece of better rank has this one at its beginning or end."""
    rows = sorted(model.normal(), key=lambda x: (-x[2], x[1]))
    rank = {p: r for r, (p, _, _) in enumerate(rows)}
    ends: set[str] = set()
    for p, r in rank.items():
        for n in range(1, len(p)):
            ends.update(q for q in (p[:n], p[n:]) if rank.get(q, -1) > r)
    return spark.createDataFrame([(p, i, s, rank[p], p in ends) for p, i, s in rows], "piece string, id int, score double, rank int, risky boolean")


def lattice(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """units (w, c, n; distinct w) with their edges, by an equi-join of substrings with the pieces.

    An edge is one long, so that sorting edges sorts by rank, then place: rank (20 bits), start (12 bits), length (8 bits), id (20 bits),
    risky (1 bit). Every unit also emits its empty substring, so that none is lost; units of more than 4096 characters emit nothing else
    and have their edges found where they are finished. Units come hashed by w from their count, so grouping them needs no shuffle.
    """
    starts = units.select("w", "c", "n", F.explode(F.expr("sequence(0, if(n > 4096, 0, n - 1))")).alias("s"))
    spans = starts.select("w", "c", "n", "s", F.explode(F.expr(f"sequence(if(s = 0, 0, 1), if(n > 4096, 0, least({longest}, n - s)))")).alias("l")).withColumn("piece", F.expr("substring(w, s + 1, l)"))
    edge = F.expr("shiftleft(cast(rank as bigint), 42) | shiftleft(cast(s as bigint), 30) | shiftleft(cast(l as bigint), 22) | shiftleft(cast(id as bigint), 1) | cast(risky as bigint)").alias("edge")
    none = pieces.sparkSession.createDataFrame([("", 0, 0.0, 0, False)], pieces.schema)
    hit = spans.join(F.broadcast(pieces.union(none)), "piece").select("w", "c", "n", edge)
    grouped = hit.groupBy("w").agg(F.first("c").alias("c"), F.first("n").alias("n"), F.collect_list("edge").alias("edges"))
    return grouped.withColumn("edges", F.expr(f"filter(edges, x -> (x & {0xFF << 22}L) > 0L)"))


_S, _L, _ID = "int(shiftright({x}, 30) & 4095L)", "int(shiftright({x}, 22) & 255L)", "int(shiftright({x}, 1) & 1048575L)"


def _ends(x: str) -> str:
    """The cuts at both ends of an edge."""
    return f"shiftleft(shiftleft(1L, {_L.format(x=x)}) | 1L, {_S.format(x=x)})"


def _inner(x: str) -> str:
    """The cuts strictly inside an edge."""
    return f"shiftleft(shiftleft(1L, {_L.format(x=x)}) - 2L, {_S.format(x=x)})"


def _mergeable(x: str, cuts: str) -> str:
    return f"(({cuts} & {_ends(x)}) = {_ends(x)} and bit_count({cuts} & {_inner(x)}) = 1)"


ODD = -1


def segmented(lat: DataFrame, bpe: bool, scores: list[float] | None = None) -> DataFrame:
    """w, c, n, edges and path: the edges of the segmentation; null where the unit is left to the exact queue."""
    if bpe:
        # the accumulator is the set of cuts, ODD once a merge allows one of better rank
        better = f"exists(m, y -> y < x and {_mergeable('y', '(a & ~' + _inner('x') + ')')})"
        step = f"if(a = {ODD}L or not {_mergeable('x', 'a')}, a, if((x & 1L) = 1L and {better}, {ODD}L, a & ~{_inner('x')}))"
        fold = f"aggregate(m, shiftleft(1L, n + 1) - 1L, (a, x) -> {step})"
        t = lat.withColumn("m", F.expr(f"sort_array(filter(edges, x -> (x & {0xFF << 22}L) > {1 << 22}L))"))
        t = t.withColumn("cuts", F.expr(f"if(n <= {LONGEST}, if(size(m) = 0, shiftleft(1L, n + 1) - 1L, {fold}), {ODD}L)"))
        path = F.expr(f"if(cuts = {ODD}L, null, filter(edges, x -> (cuts & {_ends('x')}) = {_ends('x')} and (cuts & {_inner('x')}) = 0L))")
        return t.select("w", "c", "n", "edges", path.alias("path"))
    # Viterbi: best[k] is the best score of the first k characters, with the last edge; a character of no piece costs a fixed penalty
    table = "array(" + ",".join(f"{x!r}D" for x in scores or []) + ")"
    t = lat.withColumn("sc", F.expr(f"transform(edges, x -> get({table}, {_ID.format(x='x')}))"))
    t = t.withColumn("low", F.lit(min(scores or [0.0]) - 10.0))
    t = t.withColumn("all", F.expr(
        f"if(n > {LONGEST_VITERBI}, null, array_sort(concat(zip_with(edges, sc, (x, v) -> struct({_S.format(x='x')} + {_L.format(x='x')} as e, {_S.format(x='x')} as s, v as score, x as edge)),"
        " transform(sequence(0, n - 1), s -> struct(s + 1 as e, s as s, low as score, -1L as edge)))))"
    ))
    start = "transform(sequence(0, n), k -> named_struct('score', if(k = 0, 0D, double('-Infinity')), 's', -1, 'edge', -1L))"
    step = "transform(a, (o, k) -> if(k = x.e and get(a, x.s).score + x.score > o.score, named_struct('score', get(a, x.s).score + x.score, 's', x.s, 'edge', x.edge), o))"
    short = f"n <= {LONGEST_VITERBI}"  # longer units are left to the same recurrence where they are finished
    t = t.withColumn("best", F.expr(f"if({short}, aggregate(all, {start}, (a, x) -> {step}), null)"))
    back = "aggregate(sequence(1, n), named_struct('at', n, 'path', cast(array() as array<bigint>)), (a, k) -> if(a.at <= 0, a, named_struct('at', get(best, a.at).s, 'path', concat(array(get(best, a.at).edge), a.path))), a -> filter(a.path, x -> x >= 0))"
    return t.select("w", "c", "n", "edges", F.expr(f"if({short}, {back}, null)").alias("path"))


def by_queue(n: int, edges: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """BPE over the edges (rank, start, end, id) of one unit with a priority queue: always the best rank, the leftmost of equals."""
    of = {(s, e): (r, i) for r, s, e, i in edges}
    nxt, prev = list(range(1, n + 2)), list(range(-1, n))
    alive = [True] * n
    heap = [(of[i, i + 2][0], i, i + 1, i + 2) for i in range(n - 1) if (i, i + 2) in of]
    heapq.heapify(heap)
    while heap:
        _, s, m, e = heapq.heappop(heap)
        if not (alive[s] and m < n and alive[m] and nxt[s] == m and nxt[m] == e):
            continue
        alive[m] = False
        nxt[s] = e
        if e < n:
            prev[e] = s
            if (s, nxt[e]) in of:
                heapq.heappush(heap, (of[s, nxt[e]][0], s, e, nxt[e]))
        p = prev[s]
        if p >= 0 and (p, e) in of:
            heapq.heappush(heap, (of[p, e][0], p, s, e))
    return [(i, nxt[i], of[i, nxt[i]][1]) for i in range(n) if alive[i] and (i, nxt[i]) in of]


def by_prefix(x: str, of: dict[str, tuple[float, int]], longest: int, low: float) -> list[tuple[int, int, int]]:
    """Viterbi over one long unit: the best score of every prefix with its last piece; a character of no piece costs `low`."""
    best, last = [0.0] + [float("-inf")] * len(x), [(0, -1)] * (len(x) + 1)
    for s in range(len(x)):
        for e in range(s + 1, min(len(x), s + longest) + 1):
            score, i = of.get(x[s:e], (low, -1) if e == s + 1 else (float("-inf"), -1))
            if best[s] + score > best[e]:
                best[e], last[e] = best[s] + score, (s, i)
    out, at = [], len(x)
    while at > 0:
        s, i = last[at]
        if i >= 0:
            out.append((s, at, i))
        at = s
    return out[::-1]


def unpack(x: int) -> tuple[int, int, int, int]:
    """rank, start, end, id of a packed edge."""
    s = x >> 30 & 4095
    return x >> 42, s, s + (x >> 22 & 255), x >> 1 & 1048575


def dictionary(units: DataFrame, model: Model) -> DataFrame:
    """w, c, ids (packed 32-bit little-endian integers) and lossy (whether decoding does not give w back) of every distinct unit."""
    spark = units.sparkSession
    longest = max(len(p) for p, _, _ in model.normal())
    seg = segmented(lattice(units.withColumn("n", F.length("w")), piece_table(spark, model), longest), model.bpe, [s for _, s, _ in model.pieces])
    known, unknown, fuse, bpe = model.byte_ids, model.unknown, not model.bpe, model.bpe
    rank = {p: (r, i) for r, (p, i, _) in enumerate(sorted(model.normal(), key=lambda x: (-x[2], x[1])))}

    score = {p: (s, i) for p, i, s in model.normal()}

    def edges_of(x: str) -> list[tuple[int, int, int, int]]:
        return [(*rank[x[s:e]][:1], s, e, rank[x[s:e]][1]) for s in range(len(x)) for e in range(s + 1, min(len(x), s + longest) + 1) if x[s:e] in rank]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = model.raw()
        for b in batches:
            out, lossy = [], []
            for x, edges, path in zip(b.column(0).to_pylist(), b.column(2), b.column(3).to_pylist()):
                if path is not None:
                    p = sorted([unpack(y)[1:] for y in path])
                elif not bpe:
                    p = by_prefix(x, score, longest, min(s for _, s, _ in model.pieces) - 10)
                else:
                    p = by_queue(len(x), [unpack(y) for y in edges.as_py()] if edges.is_valid else edges_of(x))
                ids, at = [], 0
                for s, e, k in [*p, (len(x), len(x), -1)]:
                    if s > at:
                        if known:
                            ids += [known[c] for c in x[at:s].encode()]
                        else:
                            ids += [unknown] * (1 if fuse else s - at)
                    if k >= 0:
                        ids.append(k)
                    at = e
                out.append(np.array(ids, "<i4").tobytes())
                lossy.append(b"".join([raw[i] for i in ids]) != x.replace(MARK, " ").encode())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary()), pa.array(lossy)], ["w", "c", "ids", "lossy"])

    seg = seg.select("w", "c", F.expr("if(path is null and n <= 4096, edges, null)").alias("edges"), "path")
    return seg.mapInArrow(finish, "w string, c long, ids binary, lossy boolean")


# a unit's edges come one after another: hashing up to so many units a task spares sorting all edges by unit; small tasks hold fewer
HASHED = {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "100000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2m"}


def sentencepiece_encode(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """id_col, ids, n_tokens, round_trip (whether every unit of the text decodes to itself, a word mark counting as a space)."""
    spark = docs.sparkSession
    with open(model_file, "rb") as f:  # the vocabulary's path is a parameter; the driver tells the model to the tasks
        model = Model.read(f.read())
    cutter = Cutter(model)
    small_batches(spark)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = src.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 0, COUNT_BYTES):
            seen = cutter.words(b.column(0))[2].dictionary_encode()
            off, units = cutter.units(seen.dictionary)
            times = np.bincount(seen.indices.to_numpy(), minlength=len(seen.dictionary))
            u = units.dictionary_encode()
            c = np.bincount(u.indices.to_numpy(), np.repeat(times, np.diff(off)), len(u.dictionary))
            yield pa.RecordBatch.from_pydict({"w": u.dictionary.cast(pa.string()), "c": pa.array(c.astype(np.int64))})

    units = src.select("text").mapInArrow(count, "w string, c long").groupBy("w").agg(F.sum("c").alias("c"))
    with settings(spark, HASHED):
        known = checkpoint(dictionary(units, model))
    told = spark.sparkContext.broadcast(most_frequent(known, frequent))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = told.value[0]
        for k, b in enumerate(blocks(batches, 1, BLOCK_BYTES)):
            order, text_off, words = cutter.words(b.column(1))
            seen = words.dictionary_encode()
            word, old = by_frequency(seen.indices.to_numpy(), len(seen.dictionary))
            word_off, units = cutter.units(seen.dictionary.take(pa.array(old)))
            u = units.dictionary_encode()
            place = pc.index_in(u.dictionary, common)
            own = u.dictionary.filter(pc.is_null(place))
            number = pc.fill_null(place, -1).to_numpy().astype(np.int32)
            number[number < 0] = len(common) + np.arange(len(own), dtype=np.int32)
            row = one_row({
                "id": b.column(0).take(pa.array(order)), "null": pc.is_null(b.column(1)).take(pa.array(order)),
                "words": np.diff(text_off).astype(np.int32), "units": np.diff(word_off).astype(np.int32), "unit": number[u.indices.to_numpy()], **planes(word),
            })
            own = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own.cast(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 32) + k]), pa.array([row], pa.binary()), own], ["block", "packed", "own"])

    def encode(block: pa.Table, own: pa.Table) -> pa.Table:
        give_back()  # what the block before took
        common, flat, off, lossy = told.value
        own = own.sort_by("k")
        raw = own.column("ids").to_pylist()
        flat = np.concatenate([flat, np.frombuffer(b"".join(raw), "<i4")])
        off = np.concatenate([off, off[-1] + np.cumsum([len(x) // 4 for x in raw], dtype=np.int64)])
        lossy = np.concatenate([lossy, own.column("lossy").to_numpy().astype(bool)])
        out = []
        for packed in block.column("packed"):
            row = pa.ipc.open_stream(packed.as_buffer()).read_next_batch()
            col = {c: row.column(c).flatten() for c in row.schema.names}
            word, unit = from_planes(col), col["unit"].to_numpy()
            text_off, word_off = (np.concatenate([[0], np.cumsum(col[c].to_numpy(), dtype=np.int64)]) for c in ("words", "units"))
            ids, ends = gathered(flat, off, unit)
            of_word = ends[word_off]  # offsets of the ids of each distinct word
            bad = np.concatenate([[0], np.cumsum(lossy[unit])])[word_off]
            bad = np.concatenate([[0], np.cumsum(np.diff(bad)[word])])[text_off]
            at = 0
            while at < len(text_off) - 1:  # a stretch of texts at a time bounds the memory
                to = max(at + 1, int(np.searchsorted(text_off, text_off[at] + STRETCH, "right")) - 1)
                got, ends = gathered(ids, of_word, word[text_off[at] : text_off[to]])
                ends = ends[text_off[at : to + 1] - text_off[at]]
                null = col["null"].slice(at, to - at)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(got), mask=null)
                none = null.to_numpy(zero_copy_only=False)
                out.append(pa.RecordBatch.from_arrays([col["id"].slice(at, to - at), lists, pa.array(np.diff(ends), mask=none), pa.array(np.diff(bad[at : to + 1]) == 0, mask=none)], [id_col, "ids", "n_tokens", "round_trip"]))
                at = to
        return pa.Table.from_batches(out)

    packed = bucketed(src.mapInArrow(pack, "block long, packed binary, own array<string>"), "block")
    own = packed.select("block", F.posexplode("own").alias("k", "w")).join(known.select("w", "ids", "lossy"), "w")
    own = checkpoint(own.select(F.col("block").alias("of"), "k", "ids", "lossy"))
    texts = packed.select("block", "packed").groupBy("block").cogroup(own.groupBy("of"))
    return texts.applyInArrow(encode, f"{id_col} {id_type}, ids array<int>, n_tokens long, round_trip boolean")


def most_frequent(known: DataFrame, most: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Up to `most` units as an array, their ids one after another with offsets, and whether each is lossy. Counts are binned, so that
    the driver gets a few bins and then no more than `most` units."""
    short = known.where(F.length("w") <= LONGEST).withColumn("bin", F.floor(F.log2("c") * 8))
    total, least = 0, None
    for r in sorted(short.groupBy("bin").count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        least = r.bin
    top = short.where(F.lit(False) if least is None else F.col("bin") >= least).select("w", "ids", "lossy").toArrow()
    sizes = pc.binary_length(top.column("ids")).to_numpy() // 4
    flat = np.frombuffer(b"".join(top.column("ids").to_pylist()), "<i4")
    return top.column("w").combine_chunks().cast(pa.large_string()), flat, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), top.column("lossy").to_numpy().astype(bool)


def sentencepiece_decode(df: DataFrame, model_file: str, *, ids_col: str = "ids", into: str = "text") -> DataFrame:
    """df with the text of the ids; null ids give a null text, ids that the model does not have raise."""
    with open(model_file, "rb") as f:
        model = Model.read(f.read())

    text = F.pandas_udf(lambda ids: _decoded(model, ids), "string")
    return df.withColumn(into, text(F.col(ids_col)))


def _decoded(model: Model, ids):  # noqa: ANN001, ANN202
    decode = model.decoder()
    return ids.map(lambda x: None if x is None else decode(x))
