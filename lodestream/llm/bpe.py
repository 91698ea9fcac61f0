"""Byte-level BPE encoding and decoding.

Encoding: a text is cut at special tokens, then into words by the vocabulary's pattern. A word starts as a doubly linked list of byte
symbols; a priority queue holds the merge rank of every neighbouring pair, ties leftmost. The best entry is merged and its two new
neighbours are pushed; an entry whose pair has changed since is stale and skipped. Words come again and again, so each Python worker
keeps the ids of a bounded number of them. Decoding concatenates the vocabulary's strings as bytes and reads them as UTF-8.

Both run where the rows are: nothing is shuffled, and a text of any length is worked through in stretches that end where no word can
cross.

Defined results: a null or empty text has no ids; null ids decode to a null text, ids outside the vocabulary decode to nothing, bytes
that are no UTF-8 to the replacement character. Repeated rows are rows; null ids of rows and any other columns play no part. An empty
table gives an empty result. Vocabularies with a normaliser, a prefix space, another pre-tokenizer than the byte-level one, or special
tokens that strip or need word borders raise ValueError.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .token_counts import PATTERN

KEPT_WORDS = 1 << 19  # words whose ids a worker keeps
KEPT_LETTERS = 40  # characters of a word that is kept
STRETCH = 1 << 17  # characters that are encoded at once
OUT_IDS = 1 << 20  # ids of an output batch; a single longer text is a batch of its own
# A word never crosses from a letter to a space before a letter.
BORDER = regex.compile(r"(?<=\p{L}) (?=\p{L})")

# The pattern's classes are those of Unicode 16; characters assigned later are neither letters nor numbers in it.
LATER = regex.compile(
    r"[\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB\U00011DE0-\U00011DE9"
    r"\U00011DF1\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6"
    r"\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2"
    r"\U0001B123-\U0001B128\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF"
    r"\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF"
    r"\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F]"
)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself where it is one, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(0x100 + rest.index(b)) for b in range(256)]


class Vocabulary:
    """raw: the bytes of each id; byte: the id of each byte; rank: of left << 32 | right; made: the id that each rank makes."""

    def __init__(self, text: str) -> None:
        d = json.loads(text)
        m, pre = d["model"], d.get("pre_tokenizer") or {}
        plain = not any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if m.get("type") != "BPE" or not plain or d.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only byte-level BPE without normaliser and prefix space")
        added = d.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("special tokens that strip or need word borders are not taken")
        of = {c: b for b, c in enumerate(byte_letters())}
        vocab = m["vocab"]
        self.raw: dict[int, bytes] = {i: bytes(of[c] for c in w) for w, i in vocab.items() if w not in {t["content"] for t in added}}
        self.raw |= {t["id"]: t["content"].encode() for t in added}
        self.special = {t["content"]: t["id"] for t in added}
        self.hidden = {t["id"] for t in added if t["special"]}
        self.byte = [vocab[c] for c in byte_letters()]
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in m["merges"]]
        self.rank = {vocab[a] << 32 | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]

    @classmethod
    def read(cls, path: str) -> str:
        """The file's text, which tasks are told; a file that is not taken raises here."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        cls(text)
        return text


def merged(word: bytes, byte: list[int], rank_of: dict[int, int], made: list[int]) -> list[int]:
    """The ids of one word."""
    ids = [byte[c] for c in word]
    n = len(ids)
    rank = [rank_of.get(a << 32 | b, -1) for a, b in zip(ids, ids[1:])]  # of the pair that starts at each symbol
    heap = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
    if not heap:
        return ids
    heapify(heap)
    rank.append(-1)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        top = heappop(heap)
        i = top & 0xFFFFFFFF
        if rank[i] != top >> 32:
            continue  # stale: the pair at this place has changed since
        new = ids[i] = made[rank[i]]
        gone = after[i]
        ids[gone] = rank[gone] = rank[i] = -1
        j = after[i] = after[gone]
        if j < n:
            before[j] = i
            r = rank[i] = rank_of.get(new << 32 | ids[j], -1)
            if r >= 0:
                heappush(heap, r << 32 | i)
        h = before[i]
        if h >= 0:
            r = rank[h] = rank_of.get(ids[h] << 32 | new, -1)
            if r >= 0:
                heappush(heap, r << 32 | h)
    return [x for x in ids if x >= 0]


class Encoder(dict):
    """Ids of words as packed 32-bit integers; a bounded number of words is kept."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.v = vocabulary
        self.pattern = regex.compile(PATTERN)
        # the same with the characters of later versions taken out of the letters and numbers
        late = LATER.pattern
        neither = PATTERN.replace(r"[^\s\p{L}\p{N}]+", rf"(?:[^\s\p{{L}}\p{{N}}]|{late})+")
        self.late = regex.compile(neither.replace(r"?\p{L}+", rf"?[\p{{L}}--{late}]+").replace(r"?\p{N}+", rf"?[\p{{N}}--{late}]+"), regex.V1)
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(vocabulary.special, key=len, reverse=True))) if vocabulary.special else None

    def __missing__(self, word: str) -> bytes:
        ids = array("i", merged(word.encode(), self.v.byte, self.v.rank, self.v.made)).tobytes()
        if len(word) <= KEPT_LETTERS:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def plain(self, text: str) -> bytes:
        """Ids of a text in which special tokens are ordinary text, in stretches."""
        out, at = [], 0
        while at < len(text):
            cut = BORDER.search(text, at + STRETCH) if len(text) - at > STRETCH else None
            part = text[at : cut.start()] if cut else text[at:]
            at = cut.start() if cut else len(text)
            words = (self.pattern if part.isascii() or not LATER.search(part) else self.late).findall(part)
            out.append(b"".join(map(self.__getitem__, words)))
        return b"".join(out)

    def encode(self, text: str, special: bool = True) -> bytes:
        if not special or self.special is None or not self.special.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self.plain(text[at : m.start()]), np.array([self.v.special[m.group()]], np.int32).tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])


_KEPT: dict[int, Encoder] = {}


def encoder(text: str) -> Encoder:
    """The encoder of a vocabulary, one for the life of the worker."""
    key = hash(text)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Encoder(Vocabulary(text))
    return _KEPT[key]


def bpe_encode(docs: DataFrame, vocabulary_file: str, *, id_col: str = "doc_id", text_col: str = "text", special: bool = True) -> DataFrame:
    """id_col and ids (array<int>). special: whether special tokens in a text are theirs or ordinary text."""
    told = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary_file))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(told.value)

        def batch(rows: pa.Array, held: list[bytes]) -> pa.RecordBatch:
            ends = np.cumsum([0, *(len(x) // 4 for x in held)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(held), np.int32)))
            return pa.RecordBatch.from_arrays([rows, ids], [id_col, "ids"])

        for b in batches:
            held, size, first = [], 0, 0
            for k, text in enumerate(b.column(1)):
                held.append(enc.encode(text.as_py() or "", special))
                size += len(held[-1]) // 4
                if size >= OUT_IDS:
                    yield batch(b.column(0).slice(first, k + 1 - first), held)
                    held, size, first = [], 0, k + 1
            if held:
                yield batch(b.column(0).slice(first), held)

    small_batches(docs.sparkSession, 200)
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids array<int>")


def bpe_decode(df: DataFrame, vocabulary_file: str, *, ids_col: str = "ids", into: str = "text", skip_special: bool = False) -> DataFrame:
    """df with the text of the ids."""
    told = df.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary_file))

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        v = encoder(told.value).v
        raw = [v.raw.get(i, b"") for i in range(max(v.raw) + 2)]  # the last stands for ids outside the vocabulary
        for i in v.hidden if skip_special else ():
            raw[i] = b""
        flat = ids.flatten().to_numpy()
        flat = np.where((flat < 0) | (flat >= len(raw)), len(raw) - 1, flat)
        ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(ids), 0).to_numpy()])
        out = [b"".join([raw[i] for i in flat[a:b].tolist()]).decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
        return pa.array(out, pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))

    return df.withColumn(into, text(F.col(ids_col)))
