"""Quality rules by distribution divergence.

Every text is reduced to two histograms: character classes, and the common words of its language. Each is held against the
reference of that language by Jensen-Shannon distance (base 2, 0 to 1). References are summed over all documents of the corpus that
pass the base rules, so that junk is no part of the norm. A text too short for a stable histogram is not judged by it.

Defined results: a null or empty text has no words, fails the base rules and is not kept. A null or unlisted language has no
reference, so only the base rules apply. Repeated rows are judged row by row; extra columns are left alone; an empty table gives an
empty result. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, covered, small_batches

# Common words of each language that has a reference.
COMMON_WORDS = {
    "en": "the of and to in is was that it for on as with are be at by this from have or an they not which",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il",
}
LANGUAGES = tuple(COMMON_WORDS)
SYMBOLS = b"#*$%&|<>"
MARKS = b".,;:!?'\"()-"
N_CLASSES = 8  # lower, upper, digit, space, mark, symbol, other ASCII, beyond ASCII

_CLASS = np.full(256, 6, np.uint8)
_CLASS[list(range(97, 123))] = 0
_CLASS[list(range(65, 91))] = 1
_CLASS[list(range(48, 58))] = 2
_CLASS[[32, *range(9, 14)]] = 3
_CLASS[list(MARKS)] = 4
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and c not in MARKS]] = 5
_CLASS[0xC0:] = 7
_CLASS[list(SYMBOLS)] = 8  # counted as symbols, and apart
_CLASS[0x80:0xC0] = 9  # the rest of a code point

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def word_sets() -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """language: sorted hashes of its common words, and their places in the histogram."""
    out = {}
    for lang, words in COMMON_WORDS.items():
        t = Texts(pa.array(words.split()))
        h = t.spans_hash(t.off[:-1], t.off[1:])
        order = np.argsort(h)
        out[lang] = h[order], order
    return out


def class_counts(t: Texts) -> np.ndarray:
    """Code points of each text by _CLASS, 10 columns."""
    cls = _CLASS[t.data]
    return np.stack([np.bincount(cls[a:b], minlength=10) for a, b in zip(t.off[:-1], t.off[1:])]) if t.n else np.zeros((0, 10), np.int64)


def measure(text: pa.Array, window: int = 5) -> dict[str, np.ndarray]:
    """The base measures of each text."""
    t = Texts(text)
    w = t.words()
    n = class_counts(t)
    out = {"n_words": w.count.astype(np.int64), "word_chars": n[:, [0, 1, 2, 4, 5, 6, 7, 8]].sum(1), "n_symbols": n[:, 8]}

    breaks = np.flatnonzero(t.data == 10)
    start = np.sort(np.concatenate([t.off[:-1], breaks + 1]))
    # a break that ends a text's last byte opens an empty line at the next text's offset: it has no word and is dropped below
    end = np.sort(np.concatenate([t.off[1:], breaks]))
    full = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)  # a word begins in it
    start, end = start[full], end[full]
    doc = np.searchsorted(t.off, start, "right") - 1
    h = t.spans_hash(start, end)
    order = np.lexsort((h, doc))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out["n_dup_lines"] = np.bincount(doc[order][1:][same], minlength=t.n).astype(np.int64)

    at, g = w.windows(window)
    d = w.doc[at]
    order = np.lexsort((g, d))
    same = (g[order][1:] == g[order][:-1]) & (d[order][1:] == d[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = covered(at[twice], window, len(w.start))
    out["n_repeat_words"] = np.bincount(w.doc[hit], minlength=t.n).astype(np.int64)
    return out


def histograms(text: pa.Array, langs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of character classes, and of the common words of each text's language with all other words last."""
    low = Texts(text, lower=True)
    n = class_counts(Texts(text))
    chars = n[:, :N_CLASSES].copy()
    chars[:, 5] += n[:, 8]
    w = low.words()
    h = w.hashes()
    width = max(len(v.split()) for v in COMMON_WORDS.values()) + 1
    words = np.zeros((low.n, width), np.int64)
    of = np.array([x if x in COMMON_WORDS else "" for x in langs], object)
    for lang, (keys, place) in word_sets().items():
        rows = of == lang
        if rows.any():
            inside = rows[w.doc]
            i = np.minimum(np.searchsorted(keys, h[inside]), len(keys) - 1)
            slot = np.where(keys[i] == h[inside], place[i], width - 1)
            words += np.bincount(w.doc[inside] * width + slot, minlength=low.n * width).reshape(low.n, width)
    return chars, words


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of the rows of p to those of q; counts are normalised first; an empty row is at distance 0."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    q = q / np.maximum(q.sum(1, keepdims=True), 1)
    m = (p + q) / 2

    def kl(a: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0).sum(1)

    return np.where(p.sum(1) > 0, np.sqrt(np.maximum((kl(p) + kl(q)) / 2, 0)), 0)


def fails(m: dict[str, np.ndarray], min_words: int, max_repeat_percent: int) -> np.ndarray:
    """The base rules."""
    return (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"])


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, min_words: int, max_repeat_percent: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Summed histograms of every listed language over all documents that pass the base rules: one partial row a batch and language,
    then a small sum."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(1).to_pylist()
            chars, words = histograms(b.column(0), langs)
            of = np.where(fails(measure(b.column(0)), min_words, max_repeat_percent), "", np.array([x or "" for x in langs], object))
            for lang in LANGUAGES:
                rows = of == lang
                if rows.any():
                    v = np.concatenate([chars[rows].sum(0), words[rows].sum(0)])
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(v), "bin": np.arange(len(v), dtype=np.int32), "n": v})

    small_batches(docs.sparkSession)
    rows = docs.select(text_col, lang_col).mapInArrow(partial, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()  # languages x bins
    width = max(len(v.split()) for v in COMMON_WORDS.values()) + 1
    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for r in rows:
        c, w = out.setdefault(r.lang, (np.zeros(N_CLASSES), np.zeros(width)))
        if r.bin < N_CLASSES:
            c[r.bin] = r.n
        else:
            w[r.bin - N_CLASSES] = r.n
    return out


def judged(b: pa.RecordBatch, text: str, lang: str, ref: dict, *, min_words: int, max_repeat_percent: int, max_char_distance: float, max_word_distance: float, min_chars: int, min_hist_words: int) -> dict[str, np.ndarray | pa.Array]:
    """The columns of quality_rules for one batch."""
    width = max(len(v.split()) for v in COMMON_WORDS.values()) + 1
    m = measure(b.column(text))
    langs = b.column(lang).to_pylist()
    chars, words = histograms(b.column(text), langs)
    rc, rw = np.zeros((b.num_rows, N_CLASSES)), np.zeros((b.num_rows, width))
    known = np.array([x in ref for x in langs])
    for i in np.flatnonzero(known):
        rc[i], rw[i] = ref[langs[i]]
    cd, wd = js_distance(chars, rc), js_distance(words, rw)
    by_char, by_word = known & (chars.sum(1) >= min_chars), known & (m["n_words"] >= min_hist_words)
    failed = fails(m, min_words, max_repeat_percent)
    odd = (by_char & (cd > max_char_distance)) | (by_word & (wd > max_word_distance))
    return m | {"base_failed": failed, "kept": ~failed & ~odd, "char_distance": pa.array(cd, mask=~by_char), "word_distance": pa.array(wd, mask=~by_word)}


DEFAULTS = {"min_words": 10, "max_repeat_percent": 20, "max_char_distance": 0.25, "max_word_distance": 0.32, "min_chars": 200, "min_hist_words": 120}


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **limits: float) -> DataFrame:
    """One row per document: the base measures, both distances (null where not judged), base_failed and kept. limits: see DEFAULTS."""
    limits = DEFAULTS | limits
    ref = references(docs, text_col, lang_col, min_words=limits["min_words"], max_repeat_percent=limits["max_repeat_percent"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cols = {id_col: b.column(0)} | judged(b, "_text", "_lang", ref, **limits)
                yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in cols.items()})

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, " + ", ".join(f"{c} long" for c in COLUMNS) + ", base_failed boolean, kept boolean, char_distance double, word_distance double"
    return docs.select(id_col, F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).mapInArrow(judge, schema)


def kept_documents(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", **limits: float) -> DataFrame:
    """The rows of docs, all columns as they are, that the rules keep: decided where the text is read, without a join."""
    limits = DEFAULTS | limits
    ref = references(docs, text_col, lang_col, min_words=limits["min_words"], max_repeat_percent=limits["max_repeat_percent"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(judged(b, text_col, lang_col, ref, **limits)["kept"])) if b.num_rows else b

    return docs.mapInArrow(keep, docs.schema)
