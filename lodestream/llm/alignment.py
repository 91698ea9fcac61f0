"""Alignment of two tokenizers over a corpus.

Both tokenizers cut the same bytes, a space and the text. A token of one and a token of the other are linked where their byte ranges
overlap. The links are the edges of a bipartite graph; union-find over them gives its components, which are exactly the smallest groups
of neighbouring tokens with common ends on both sides. Members of a component expand to its links; each block of documents adds up in
how many documents it holds an id pair linked, and the blocks' pairs are counted over the corpus.

A block is one row: its documents' ids, packed, and its distinct pairs. The counts of its pairs come back to it by two equi-joins, on the
pair and on the block, in which a pair has one row a block at most. The blocks' table is bucketed by block, so the tokens are never shuffled. Nothing is told to all tasks but the two vocabularies.

Side A is a byte-level BPE vocabulary, side B a SentencePiece model that puts a space before the text; in both, special tokens in a text
are ordinary text. Long texts are cut into stretches between a letter and a space before a letter, where neither tokenizer has a token
that crosses, and which therefore ends a group.

Defined results: a text that is null or empty, or whose tokens on either side do not spell it out (a text with a word mark of B, for
one), has no tokens: zeros and no groups. Repeated rows are documents of their own; ids may be null and of any type, other columns play
no part. An empty table has empty results.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import BORDER, KEPT_LETTERS, LATER, STRETCH, Encoder, Vocabulary, merged
from .common import bucketed, checkpoint, give_back, small_batches
from .sentencepiece_lattice import MARK, Cutter, Model, blocks, from_planes, one_row, planes

BLOCK_BYTES = 8 << 20  # of the texts that are one row; a single longer text is a block of its own
PAIR = 1 << 32
SCANNED = 32  # bytes of a short word
TOGETHER = 1 << 14  # words that are scanned together
RECENT_WORDS = 1 << 17  # words of a generation; a worker keeps two on each side


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find over the links (a[i], b[i]) of n nodes: the smallest node of each node's component.

    All links are united at once: the larger root of a link is hung under the smaller one, then every node under its root; links within a
    component drop out.
    """
    root = np.arange(n, dtype=a.dtype)
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


class Recent(dict):
    """Ids of words in two generations: when the younger is full it becomes the older one, and words that are met again move on. Frequent
    words stay, and rare ones, which are most, take no more than a bounded place."""

    old: dict[str, bytes] = {}  # never changed, only replaced

    def keep(self, word: str, ids: bytes) -> bytes:
        if len(self) >= RECENT_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Scanned(Recent, Encoder):
    """Side A's encoder. The few pairs of a short word are scanned for their least rank, leftmost first, which is what the queue of longer
    words gives."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__(vocabulary)
        byte, self.none = vocabulary.byte, len(vocabulary.made)
        self.first = [vocabulary.rank.get(byte[a] << 32 | byte[b], self.none) for a in range(256) for b in range(256)]  # rank of two bytes
        # the same as arrays, for many words at once
        pair = np.fromiter(vocabulary.rank, np.int64, len(vocabulary.rank))
        rank = np.fromiter(vocabulary.rank.values(), np.int64, len(pair))
        order = np.argsort(pair)
        self.pair, self.rank_of = np.append(pair[order], np.iinfo(np.int64).max), np.append(rank[order], self.none)
        self.byte_of, self.first_of, self.made = np.array(byte), np.array(self.first), np.array(vocabulary.made, np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 32 | right
        at = np.searchsorted(self.pair, pair)
        return np.where(self.pair[at] == pair, self.rank_of[at], self.none)

    def scanned_all(self, words: list[bytes]) -> list[bytes]:
        """What `scanned` gives for each word, packed. All words go on together: every merge takes a symbol from a word, so the words of
        each length, from the longest on, are scanned with the longer ones that have come down to it."""
        size = np.array([len(w) for w in words])
        out = [b""] * len(words)
        word, ids, rank = np.zeros(0, np.int64), np.zeros((0, 0), np.int64), np.zeros((0, 0), np.int64)
        for n in range(int(size.max(initial=0)), 0, -1):
            more = np.flatnonzero(size == n)
            if len(more):
                raw = np.frombuffer(b"".join([words[i] for i in more]), np.uint8).reshape(-1, n).astype(np.int64)
                own = self.byte_of[raw], self.first_of[raw[:, :-1] << 8 | raw[:, 1:]]
                ids, rank = (np.concatenate([x.reshape(len(word), y.shape[1]), y]) for x, y in zip((ids, rank), own))
                word = np.concatenate([word, more])
            if not len(word):
                continue
            row = np.arange(len(word))
            at = rank.argmin(axis=1) if n > 1 else np.zeros(len(word), np.int64)
            best = rank[row, at] if n > 1 else np.full(len(word), self.none)
            done = best == self.none
            told = ids[done].astype(np.int32).tobytes()
            for k, i in enumerate(word[done].tolist()):
                out[i] = told[4 * n * k : 4 * n * (k + 1)]
            on = ~done
            word, ids, rank, at, best = word[on], ids[on], rank[on], at[on], best[on]
            row, new = row[: len(word)], self.made[best]
            ids[row, at] = new
            keep = np.ones(ids.shape, bool)
            keep[row, at + 1] = False
            ids = ids[keep].reshape(len(row), n - 1)
            keep = np.ones(rank.shape, bool)
            keep[row, at] = False
            rank = rank[keep].reshape(len(row), max(n - 2, 0))
            k = np.flatnonzero(at < n - 2)  # pairs with the symbol after and the one before
            rank[k, at[k]] = self.ranks(new[k], ids[k, at[k] + 1])
            k = np.flatnonzero(at > 0)
            rank[k, at[k] - 1] = self.ranks(ids[k, at[k] - 1], new[k])
        return out

    def cut(self, text: str) -> list[str]:
        """The pattern's words."""
        return (self.pattern if text.isascii() or not LATER.search(text) else self.late).findall(text)

    def prepare(self, words: list[str]) -> None:
        """Keeps the ids of the words, the short ones of which are scanned together."""
        new = [w for w in words if len(w) <= KEPT_LETTERS and w not in self and w not in self.old]
        for w, ids in self.short(new, [w.encode() for w in new]):
            self.keep(w, ids)

    def short(self, names: list[str], words: list[bytes]) -> Iterator[tuple[str, bytes]]:
        """The ids of the short ones of the words, with their names."""
        at = [i for i, w in enumerate(words) if len(w) <= SCANNED]
        for k in range(0, len(at), TOGETHER):
            some = at[k : k + TOGETHER]
            yield from zip([names[i] for i in some], self.scanned_all([words[i] for i in some]))

    def scanned(self, word: bytes) -> list[int]:
        """The ids of one word."""
        byte, made, first, none, get = self.v.byte, self.v.made, self.first, self.none, self.v.rank.get
        ids = [byte[c] for c in word]
        rank = [first[a << 8 | b] for a, b in zip(word, word[1:])]
        while rank and (r := min(rank)) != none:
            i = rank.index(r)
            new = ids[i] = made[r]
            del ids[i + 1], rank[i]
            if i < len(rank):
                rank[i] = get(new << 32 | ids[i + 1], none)
            if i:
                rank[i - 1] = get(ids[i - 1] << 32 | new, none)
        return ids

    def __missing__(self, word: str) -> bytes:
        if (ids := self.old.get(word)) is not None:
            return self.keep(word, ids)
        raw = word.encode()
        ids = array("i", self.scanned(raw) if len(raw) <= SCANNED else merged(raw, self.v.byte, self.v.rank, self.v.made)).tobytes()
        return self.keep(word, ids) if len(word) <= KEPT_LETTERS else ids


class Chunks(Recent):
    """Side A's ids of a space and what stands before the next one. A word of the pattern begins at every space that has no white space
    on both sides, so these chunks are encoded one by one."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.v = vocabulary
        self.words = Scanned(vocabulary)
        self.spaced = False

    def prepare(self, texts: list[str]) -> None:
        """Encodes the chunks of the texts that are not kept, their words together."""
        new = [c for c in set(chain.from_iterable(t.split(" ") for t in texts)) if 0 < len(c) <= KEPT_LETTERS and c not in self and c not in self.old and not c[0].isspace()]
        letters, others = [], []
        for c in new:
            (letters if one_word(c) else others).append(c)
        for c, ids in self.words.short(letters, [b" " + c.encode() for c in letters]):
            self.keep(c, ids)
        for at in range(0, len(others), TOGETHER):
            some = others[at : at + TOGETHER]
            cut = [self.words.cut(" " + c) for c in some]
            self.words.prepare(list(set(chain.from_iterable(cut))))
            for c, words in zip(some, cut):
                self.keep(c, b"".join(map(self.words.__getitem__, words)))

    def __missing__(self, chunk: str) -> bytes:
        if (ids := self.old.get(chunk)) is not None:
            return self.keep(chunk, ids)
        if chunk[:1].isspace():  # its space may belong to white space before it
            self.spaced = True
            return b""
        ids = self.words.plain(" " + chunk)
        return self.keep(chunk, ids) if len(chunk) <= KEPT_LETTERS else ids

    def encode(self, text: str, chunks: list[str]) -> bytes:
        """The ids of a space and the text, which is the chunks with single spaces between them."""
        self.spaced = False
        out = b"".join(map(self.__getitem__, chunks))
        return self.words.plain(" " + text) if self.spaced else out


def one_word(chunk: str) -> bool:
    """Letters only: a word of the pattern with the space before."""
    return chunk.isalpha() and (chunk.isascii() or not LATER.search(chunk))


def chunks(text: str) -> list[str]:
    """What stands between the spaces; a text with empty chunks is one."""
    return [text] if "  " in text or text[:1] == " " or text[-1:] == " " else text.split(" ")


@dataclass
class Aligned:
    """Stretches of one or more documents: link_a, link_b (places of linked tokens) and the component of each token."""

    link_a: np.ndarray
    link_b: np.ndarray
    of_a: np.ndarray
    of_b: np.ndarray


def links(len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked tokens. len_a, len_b: bytes of the tokens of two cuts of the same bytes."""
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    first = np.searchsorted(end_b, end_a - len_a, "right")  # the token of B that holds the first byte of each of A
    last = np.searchsorted(end_b, end_a, "left")
    times = last - first + 1
    link_a = np.repeat(np.arange(len(len_a), dtype=np.int32), times)
    link_b = (np.arange(len(link_a)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)).astype(np.int32)
    return link_a, link_b


def align(len_a: np.ndarray, len_b: np.ndarray) -> Aligned:
    """The links with their components."""
    link_a, link_b = links(len_a, len_b)
    root = components(len(len_a) + len(len_b), link_a, link_b + np.int32(len(len_a)))
    return Aligned(link_a, link_b, root[: len(len_a)], root[len(len_a) :])


class Pieces(Recent):
    """Ids of side B, packed, of what stands between two spaces; a bounded number is kept. No piece crosses from a character to a word
    mark, so words are encoded one by one."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.raw = Model.read(model).raw()
        self.odd = False

    def __missing__(self, word: str) -> bytes:
        if (out := self.old.get(word)) is not None:
            return self.keep(word, out)
        return self.spelt(word, self.model.encode(word))

    def spelt(self, word: str, ids: list[int]) -> bytes:
        """The ids, packed; kept if they spell out the word."""
        out = array("i", ids).tobytes()
        if b"".join([self.raw[i] for i in ids]) != (" " + word).encode():
            self.odd = True
        elif len(word) <= KEPT_LETTERS:
            self.keep(word, out)
        return out

    def prepare(self, texts: list[str]) -> None:
        """Encodes the words of the texts that are not kept, all in one call: most of a call's time is its own."""
        new = [w for w in set(chain.from_iterable(t.split(" ") for t in texts)) if len(w) <= KEPT_LETTERS and w not in self and w not in self.old and MARK not in w]
        for word, ids in zip(new, self.model.encode(new, num_threads=1)):
            self.spelt(word, ids)

    def encode(self, words: list[str]) -> bytes | None:
        """None where the ids do not spell out a space and the words with single spaces between them."""
        self.odd = False
        out = b"".join(map(self.__getitem__, words))
        return None if self.odd else out


class Sides:
    """Both tokenizers in a worker, with the lengths of their tokens."""

    def __init__(self, a: str, b: bytes) -> None:
        self.a = Chunks(Vocabulary(a))
        self.b = Pieces(b)
        self.len_a = np.array([len(self.a.v.raw.get(i, b"")) for i in range(max(self.a.v.raw) + 1)])
        self.len_b = np.array([len(x) for x in self.b.raw])
        # an id and what follows it: place 4 * id + separator
        self.told = pa.array([f"{i}{s}" for i in range(max(len(self.len_a), len(self.len_b))) for s in ("", ",", "|", ";")])

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids on both sides, or None where they do not spell out a space and the text."""
        out_a, out_b, at = [], [], 0
        while at < len(text):
            cut = BORDER.search(text, at + STRETCH) if len(text) - at > STRETCH else None
            part = text[at : cut.start()] if cut else text[at:]
            at = cut.end() if cut else len(text)  # the space at the cut is the one that both put before the next stretch
            parts = chunks(part)
            a, b = np.frombuffer(self.a.encode(part, parts), np.int32), self.b.encode(parts)
            if b is None or self.len_a[a].sum() != len(part.encode()) + 1:  # A's merges never change a byte
                return None
            out_a.append(a)
            out_b.append(np.frombuffer(b, np.int32))
        return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else None

    def groups(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, n: np.ndarray) -> pa.StringArray:
        """The groups of documents of n tokens each as texts, a1,a2|b1;a3|b2,b3: of_a and of_b number the groups."""
        key = np.concatenate([2 * of_a, 2 * of_b + 1])
        order = np.argsort(key, kind="stable")
        key = key[order]
        step = np.append(np.where(key[1:] == key[:-1], 1, np.where(key[1:] // 2 == key[:-1] // 2, 2, 3)), 0) if len(key) else key
        ends = np.cumsum(n)
        step[ends[n > 0] - 1] = 0  # a document's last token
        tokens = self.told.take(pa.array(4 * np.concatenate([a, b])[order].astype(np.int64) + step)).cast(pa.large_string())
        _, off, data = tokens.buffers()
        off = np.frombuffer(off, np.int64)[tokens.offset : tokens.offset + len(tokens) + 1] if len(tokens) else np.zeros(1, np.int64)
        return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(off[np.append(0, ends)].copy()), data or pa.py_buffer(b"")).cast(pa.string())


_SIDES: list[tuple[int, Sides]] = []


def sides(a: str, b: bytes) -> Sides:
    """The two tokenizers, kept for the life of the worker."""
    key = hash((a, b))
    if not _SIDES or _SIDES[0][0] != key:
        _SIDES[:] = [(key, Sides(a, b))]
    return _SIDES[0][1]


def stretches(n_a: np.ndarray, n_b: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about `most` tokens each."""
    size, at = np.cumsum(n_a + n_b), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


PREPARED = 200  # texts whose new words are looked up at once
TOKENS = 1 << 17  # of the documents that are aligned at once; a longer document is aligned by itself


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a sorted array and where each begins."""
    begin = np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]]))
    return x[begin], begin


def linked_pairs(s: Sides, ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the linked pairs of the documents, sorted, and how many of these documents hold each."""
    off_a, off_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
    width = len(s.len_b)  # of a pair as one number; with a document's place behind it, it is sorted as a plain value
    kinds, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in stretches(n_a, n_b, TOKENS):
        a, b = ids_a[off_a[lo] : off_a[hi]], ids_b[off_b[lo] : off_b[hi]]
        link_a, link_b = links(s.len_a[a], s.len_b[b])
        doc = np.repeat(np.arange(hi - lo), n_a[lo:hi])[link_a]
        once, _ = runs(np.sort((a[link_a].astype(np.int64) * width + b[link_b]) * (hi - lo) + doc))  # a pair counts once a document
        pair, begin = runs(once // (hi - lo))
        kinds.append(pair)
        held.append(np.diff(np.append(begin, len(once))))
    pair, count = np.concatenate(kinds), np.concatenate(held)
    order = np.argsort(pair)
    pair, begin = runs(pair[order])
    return pair // width * PAIR + pair % width, np.add.reduceat(count[order], begin) if len(begin) else count


def aligned_pairs(s: Sides, ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> Iterator[tuple[int, int, int, int, Aligned, np.ndarray, np.ndarray]]:
    """For ranges of documents: first document, last, first tokens of both sides, the alignment, the pair code of each link and its document."""
    off_a, off_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
    for lo, hi in stretches(n_a, n_b, TOKENS):
        a, b = ids_a[off_a[lo] : off_a[hi]], ids_b[off_b[lo] : off_b[hi]]
        x = align(s.len_a[a], s.len_b[b])
        doc = np.repeat(np.arange(lo, hi, dtype=np.int32), n_a[lo:hi])[x.link_a]
        yield lo, hi, int(off_a[lo]), int(off_b[lo]), x, a[x.link_a].astype(np.int64) * PAIR + b[x.link_b], doc


def cross_tokenizer_alignment(docs: DataFrame, vocabulary_file: str, model_file: str, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, pairs).

    documents: id_col, n_a, n_b, n_groups, n_links, n_best (links whose pair no other pair of the same A id exceeds), count_sum (of the
    links' counts), groups (in order, as a1,a2|b1;a3|b2,b3 of the ids of both sides). pairs: a, b, documents (that hold the pair linked), best.
    """
    spark = docs.sparkSession
    with open(model_file, "rb") as f:
        model = f.read()
    Cutter(Model.read(model))  # raises for models with pieces that cross from a character to a word mark
    told = spark.sparkContext.broadcast((Vocabulary.read(vocabulary_file), model))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    small_batches(spark, 200)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sides(*told.value)
        for k, block in enumerate(blocks(batches, 1, BLOCK_BYTES)):
            none = (np.zeros(0, np.int32),) * 2
            ids = []
            for at in range(0, block.num_rows, PREPARED):
                texts = [t or "" for t in block.column(1).slice(at, PREPARED).to_pylist()]
                s.a.prepare(texts)
                s.b.prepare(texts)
                ids += [s.encode(t) or none for t in texts]
            a, b = (np.concatenate([x[i] for x in ids]) for i in (0, 1))
            n_a, n_b = (np.array([len(x[i]) for x in ids], np.int64) for i in (0, 1))
            del ids
            kinds, count = linked_pairs(s, a, b, n_a, n_b)
            tokens = {f"{side}_{c}": v for side, ids in (("a", a), ("b", b)) for c, v in planes(ids).items()}
            row = one_row({"id": block.column(0), "n_a": n_a.astype(np.int32), "n_b": n_b.astype(np.int32), **tokens})
            lists = [pa.ListArray.from_arrays(pa.array([0, len(kinds)], pa.int32()), pa.array(v)) for v in (kinds, count)]
            yield pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 32) + k]), pa.array([row], pa.binary()), *lists], ["block", "packed", "pairs", "counts"])

    encoded = bucketed(src.mapInArrow(encode, "block long, packed binary, pairs array<long>, counts array<long>"), "block")
    own = encoded.select("block", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("block", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("c"))
    summed = own.groupBy("pair").agg(F.sum("c").alias("documents")).withColumn("a", F.shiftright("pair", 32))
    best = F.col("documents") == F.max("documents").over(Window.partitionBy("a"))  # an id has no more partners than B has ids
    pairs = checkpoint(summed.select("pair", "a", F.col("pair").bitwiseAND(F.lit(PAIR - 1)).alias("b"), "documents", best.alias("best")))
    back = checkpoint(own.select("block", "pair").join(pairs.select("pair", "documents", "best"), "pair"))

    def finish(block: pa.Table, counts: pa.Table) -> pa.Table:
        give_back()  # what the block before took
        s = sides(*told.value)
        counts = counts.sort_by("pair")
        kinds, documents, best = (counts.column(c).to_numpy() for c in ("pair", "documents", "best"))
        out = []
        for packed in block.column("packed"):
            row = pa.ipc.open_stream(packed.as_buffer()).read_next_batch()
            col = {c: row.column(c).flatten() for c in row.schema.names}
            n_a, n_b = (col[c].to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
            a, b = (from_planes({c[2:]: v for c, v in col.items() if c.startswith(f"{side}_word")}).astype(np.int32) for side in "ab")
            for lo, hi, at_a, at_b, x, code, doc in aligned_pairs(s, a, b, n_a, n_b):
                place = np.searchsorted(kinds, code)
                n = hi - lo
                links = np.bincount(doc - lo, minlength=n)
                n_best = np.bincount(doc - lo, best[place], n).astype(np.int64)
                c = np.concatenate([[0], np.cumsum(documents[place])])[np.concatenate([[0], np.cumsum(links)])]
                first = x.of_a == np.arange(len(x.of_a))  # a component's smallest node is its first token of A
                group = np.cumsum(first) - 1
                of_doc = np.concatenate([[0], np.cumsum(n_a[lo:hi])])
                in_doc = np.concatenate([[0], np.cumsum(first)])[of_doc]  # groups before each document
                groups = s.groups(a[at_a : at_a + len(x.of_a)], b[at_b : at_b + len(x.of_b)], group, group[x.of_b], n_a[lo:hi] + n_b[lo:hi])
                numbers = [pa.array(v.astype(np.int64)) for v in (n_a[lo:hi], n_b[lo:hi], np.diff(in_doc), links, n_best, np.diff(c))]
                out.append(pa.RecordBatch.from_arrays([col["id"].slice(lo, n), *numbers, groups], [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]))
        return pa.Table.from_batches(out)

    longs = ", ".join(f"{c} long" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    by_block = encoded.select("block", "packed").groupBy("block").cogroup(back.select(F.col("block").alias("of"), "pair", "documents", "best").groupBy("of"))
    documents = by_block.applyInArrow(finish, f"`{id_col}` {id_type}, {longs}, groups string")
    return documents, pairs.select("a", "b", "documents", "best")
