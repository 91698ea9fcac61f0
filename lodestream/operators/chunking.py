"""Chunkers: documents (doc_id, text) to chunks (chunk_id, document_id, index, start_char, end_char, content)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences
from .tables import spread

SEPARATORS = ("\n\n", "\n", ". ", " ", "")
ROWS = 20_000  # of a batch that leaves Python
# Unicode's white space, as Spark's regular expressions have it; capitals that Spark's lower() knows and Unicode 15 does not.
_SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, **{c: c + 32 for c in range(0x10D50, 0x10D66)}}
_SPACE, _SENTENCE_END = re.compile(f"[{_SPACES}]+"), re.compile(f"(?<=[.!?])([{_SPACES}]+)")
_ODD = re.compile("[\x1c-\x1f" + "".join(map(chr, _CAPITALS)) + "]")  # \x1c to \x1f only Python takes for white space


def checked(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("chunk_size must be positive and chunk_overlap smaller")


def _identified(pieces: DataFrame) -> DataFrame:
    return pieces.select(F.concat_ws("#", F.col("document_id").cast("string"), F.col("index").cast("string")).alias("chunk_id"), "document_id", "index", "start_char", "end_char", "content")


def fixed_chunks(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """Windows of `size` characters every size - overlap over the whole text; blank windows are dropped and not counted."""
    checked(size, overlap)
    step = size - overlap
    spans = F.expr(f"transform(sequence(0, greatest(length(text) - 1, 0), {step}), p -> struct(p as start_char, least(p + {size}, length(text)) as end_char, substring(text, p + 1, {size}) as content))")
    kept = F.filter(spans, lambda s: ~s["content"].rlike(r"(?U)^\s*$"))
    d = spread(docs).where(F.length("text") > 0).select(F.col("doc_id").alias("document_id"), F.posexplode(kept).alias("index", "s"))
    return _identified(d.select("document_id", "index", "s.*"))


def _located(groups: DataFrame) -> DataFrame:
    """groups (document_id, text, parts): offsets by search from one past the chunk before; a part that is not in the text is put where
    the search began."""
    found = "locate(p, text, a.off + 1)"
    start = f"if({found} > 0, {found} - 1, a.off)"
    fold = F.expr(
        "aggregate(parts, named_struct('off', 0, 'out', cast(array() as array<struct<start_char:int,end_char:int,content:string>>)),"
        f" (a, p) -> named_struct('off', greatest(a.off, {start} + 1), 'out', array_append(a.out, named_struct('start_char', {start}, 'end_char', {start} + length(p), 'content', p))), a -> a.out)"
    )
    return _identified(groups.select("document_id", F.posexplode(fold).alias("index", "s")).select("document_id", "index", "s.*"))


def sentence_groups(size: int, overlap: int) -> str:
    """SQL: folds the array `sentences` into packed groups. On a flush the last whole sentences of at most `overlap` characters carry
    over; the length added after a flush is the one counted before it."""
    tail = f"aggregate(reverse(a.cur), named_struct('n', 0, 'stop', false, 'keep', cast(array() as array<string>)), (t, x) -> if(t.stop or t.n + length(x) + 1 > {overlap}, named_struct('n', t.n, 'stop', true, 'keep', t.keep), named_struct('n', t.n + length(x) + 1, 'stop', false, 'keep', array_prepend(t.keep, x))), t -> t.keep)"
    added = "(length(s) + if(size(a.cur) > 0, 1, 0))"
    flushed = f"named_struct('groups', array_append(a.groups, array_join(a.cur, ' ')), 'cur', array_append({tail}, s), 'len', aggregate({tail}, 0, (t, x) -> t + length(x)) + greatest(size({tail}) - 1, 0) + {added})"
    kept = f"named_struct('groups', a.groups, 'cur', array_append(a.cur, s), 'len', a.len + {added})"
    return (
        "aggregate(sentences, named_struct('groups', cast(array() as array<string>), 'cur', cast(array() as array<string>), 'len', 0),"
        f" (a, s) -> if(a.len + {added} > {size} and size(a.cur) > 0, {flushed}, {kept}),"
        " a -> if(size(a.cur) > 0, array_append(a.groups, array_join(a.cur, ' ')), a.groups))"
    )


def sentence_chunks(docs: DataFrame, size: int = 512, overlap: int = 50, min_length: int = 5) -> DataFrame:
    checked(size, overlap)
    d = spread(docs).select(F.col("doc_id").alias("document_id"), "text", sentences(F.col("text"), min_length).alias("sentences"))
    return _located(d.withColumn("parts", F.expr(sentence_groups(size, overlap))))


def semantic_groups(text: str, size: int, threshold: float) -> Iterator[tuple[int, str]]:
    """(start, content) of the groups of neighbouring sentences, each searched for from one past the start of the one before; one that is
    not in the text is put where the search began."""
    pieces = _SENTENCE_END.split(text)
    odd = _ODD.search(text) is not None
    joined = _Joins(text)
    off, cur, clean, first, before = 0, "", True, 0, None

    def placed() -> tuple[int, str]:
        nonlocal off
        k = text.find(cur, off) if clean or joined.may_stand(cur, first) else -1
        start = k if k >= 0 else off
        off = max(off, start + 1)
        return start, cur

    for i in range(0, len(pieces), 2):
        if not (s := pieces[i].strip(_SPACES)):
            continue
        bag = set(_SPACE.split(s.translate(_CAPITALS).lower()) if odd else s.lower().split())
        if cur and len(cur) + 1 + len(s) <= size and _alike(before, bag) >= threshold:
            if clean and pieces[i - 1] != " ":
                clean, first = False, len(cur)
            cur += " " + s
        else:
            if cur:
                yield placed()
            cur, clean = s, True
        before = bag
    if cur:
        yield placed()


def _alike(a: set[str], b: set[str]) -> float:
    both = len(a & b)
    return both / n if (n := len(a) + len(b) - both) else 0.0


class _Joins:
    """What stands around the single spaces between sentences of a text. A group whose sentences are parted otherwise can stand in the text
    only where another place reads the same; without that, each such group would be searched for as far as the text's end."""

    def __init__(self, text: str) -> None:
        self.text, self.around = text, {}

    def may_stand(self, group: str, at: int) -> bool:
        """at: the place of a join in the group."""
        n = 1 << min(at, len(group) - at - 1, 16).bit_length() - 1
        if n not in self.around:
            self.around[n] = {self.text[max(0, k - n) : k + 1 + n] for m in _SENTENCE_END.finditer(self.text) if m[0] == " " for k in (m.start(),)}
        return group[at - n : at + 1 + n] in self.around[n]


def semantic_chunks(docs: DataFrame, size: int = 512, threshold: float = 0.3) -> DataFrame:
    """Neighbouring sentences stay together while they fit and each is similar enough to the one before it (Jaccard of lower-case words).
    The work grows with the text: it runs over Arrow batches, document by document."""
    checked(size, 0)

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for d, t in enumerate(b.column(1)):
                for i, (start, c) in enumerate(semantic_groups((t.as_py() or b"").decode(errors="replace"), size, threshold)):
                    rows.append((d, i, start, start + len(c), c))
                    if len(rows) == ROWS:
                        yield packed(b, rows)
                        rows = []
            yield packed(b, rows)

    def packed(b: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        at, *cols = zip(*rows) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *map(pa.array, cols, (pa.int32(), pa.int32(), pa.int32(), pa.string()))], ["document_id", "index", "start_char", "end_char", "content"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = spread(docs.select("doc_id", "text")).select("doc_id", F.col("text").cast("binary"))  # a byte that is no character must not end the job
    return _identified(rows.mapInArrow(chunk, f"document_id {kind}, index int, start_char int, end_char int, content string"))


def split_recursive(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Parts of at most `size` characters: runs between the first separator as long as they fit; a run that is too long by itself is
    split on by the next separator, at last cut hard. Blank parts go."""
    ladder = [s for s in separators if s]

    def parts(piece: str, level: int) -> Iterator[str]:
        if len(piece) <= size:
            yield piece
        elif level == len(ladder):
            yield from (piece[i : i + size] for i in range(0, len(piece), size))
        else:
            run = ""
            for part in piece.split(ladder[level]):
                grown = run + ladder[level] + part if run else part
                if len(grown) <= size:
                    run = grown
                    continue
                yield run
                run = part if len(part) <= size else ""
                if not run:
                    yield from parts(part, level + 1)
            yield run

    return [p for p in parts(text, 0) if p.strip()]


def merge_pieces(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Neighbours joined by one space while they fit; then each takes the last `overlap` characters of the one before, if it still fits."""
    merged: list[str] = []
    for p in pieces:
        if merged and len(merged[-1]) + 1 + len(p) <= size:
            merged[-1] += " " + p
        else:
            merged.append(p)
    if overlap <= 0:
        return merged
    out = merged[:1]
    for before, p in zip(merged, merged[1:]):
        longer = before[-overlap:] + " " + p
        out.append(longer if len(longer) <= size else p)
    return out


def recursive_chunks(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """A recursive splitter is sequential by nature: it runs over Arrow batches, document by document."""
    checked(size, overlap)

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                off = 0
                for i, c in enumerate(merge_pieces(split_recursive(t or "", size), size, overlap)):
                    k = t.find(c, off)
                    start = k if k >= 0 else off
                    off = max(off, start + 1)
                    rows.append((d, i, start, start + len(c), c))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_pydict({n: pa.array(list(c), k) for n, c, k in zip(("document_id", "index", "start_char", "end_char", "content"), cols, (b.column(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string()))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _identified(spread(docs.select("doc_id", "text")).mapInArrow(chunk, f"document_id {kind}, index int, start_char int, end_char int, content string"))


def renumbered(chunks: DataFrame) -> DataFrame:
    """Index from 0 per document in order of place."""
    w = Window.partitionBy("document_id").orderBy("start_char", "index")
    return chunks.withColumn("index", F.row_number().over(w) - 1)
