"""Quality classifier: a generalised additive model with pairwise interactions.

Every text is reduced to a few shape features. Shallow trees (at most three leaves) are boosted in turn on one feature's histogram at
a time, at a small rate, so that their sum is a lookup table per feature; the pairs that explain most of what is left get small
two-dimensional tables in the same way. A score is a sum of table entries, looked up for a whole batch at once.

The model is fitted on the driver on at most `sample` labelled rows (a documented bound: the rows of smallest hashed id); every
document is then read whole and scored. Labels, language, source and ids are no features.

Defined results: null, empty and blank texts have all features zero and get the score the model gives those. Without any usable label
every score is 0.5. Rows whose label is null or not 0 or 1 are not used. Rows with a null id are scored and not held out. Repeated rows
are scored each; of rows that repeat a labelled id with another text, the one of smallest features is learned from. An empty table
gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Texts, small_batches
from .quality_rules import COMMON_WORDS, class_counts, measure

FEATURES = (
    "log_words", "word_length", "upper", "digit", "mark", "symbol", "other", "beyond_ascii", "exclamations", "bars",
    "dup_lines", "repeat_words", "distinct_words", "longest_word", "common_words", "marked_words", "lines_per_word", "caps_words",
)


def _common() -> np.ndarray:
    t = Texts(pa.array(sorted({w for v in COMMON_WORDS.values() for w in v.split()})))
    return np.sort(t.spans_hash(t.off[:-1], t.off[1:]))


_COMMON = _common()
_MARKED = np.zeros(256, bool)
_MARKED[list(b"!#*$%&|<>")] = True


def features(text: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    t = Texts(text)
    w = t.words()
    n = class_counts(t).astype(float)
    m = measure(text)
    chars, words = np.maximum(n[:, :9].sum(1), 1), np.maximum(w.count, 1)
    low = Texts(text, lower=True)
    lh = low.spans_hash(w.start, w.end) if len(w.start) else np.zeros(0, np.uint64)
    common = _COMMON[np.minimum(np.searchsorted(_COMMON, lh), len(_COMMON) - 1)] == lh
    order = np.lexsort((lh, w.doc))
    new = np.ones(len(lh), bool)
    new[1:] = (lh[order][1:] != lh[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    per = lambda x: np.bincount(w.doc[x], minlength=t.n)
    longest = np.zeros(t.n)
    np.maximum.at(longest, w.doc, w.end - w.start)
    byte = lambda c: t.sums(t.data == c)
    last = t.data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    first = t.data[w.start] if len(w.start) else np.zeros(0, np.uint8)
    second = t.data[np.minimum(w.start + 1, len(t.data) - 1)] if len(w.start) else first
    capital = lambda x: (x >= 65) & (x <= 90)
    cols = [
        np.log1p(w.count), m["word_chars"] / words, n[:, 1] / chars, n[:, 2] / chars, n[:, 4] / chars, n[:, 8] / chars, (n[:, 5] + n[:, 6]) / chars, n[:, 7] / chars,
        byte(33) / words, byte(124) / words, m["n_dup_lines"] / words, m["n_repeat_words"] / words, per(order[new]) / words, np.log1p(longest), per(common) / words,
        per(_MARKED[last]) / words, byte(10) / words, per(capital(first) & capital(second) & (w.end - w.start > 1)) / words,
    ]
    return np.stack(cols, 1) * (w.count > 0)[:, None]


@dataclass
class Additive:
    """bias + sum of tables[f][bin] + sum of pairs[(f, g)][bin, bin]."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    bias: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for f, t in enumerate(self.tables):
            out += t[np.searchsorted(self.edges[f], x[:, f], "right")]
        for (f, g), t in self.pairs.items():
            out += t[np.searchsorted(self.coarse[f], x[:, f], "right"), np.searchsorted(self.coarse[g], x[:, g], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """The best place to split a histogram, with its gain; place k: bins up to k go left."""
    if len(g) < 2:
        return 0.0, -1
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a**2 / (b + ridge) + (g.sum() - a) ** 2 / (h.sum() - b + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(np.argmax(gain))
    return float(gain[k]), k


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The values of a shallow regression tree over one histogram, grown where it gains most."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, k, i = max((*_cut(g[a:b], h[a:b], ridge), -i) for i, (a, b) in enumerate(parts))
        if k < 0 or gain <= 1e-9:
            break
        a, b = parts.pop(-i)
        parts += [(a, a + k + 1), (a + k + 1, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _square(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """A tree of depth two over a two-dimensional histogram: one cut of the first feature, one of the second on either side."""
    best = (0.0, np.zeros(g.shape))
    for k in range(g.shape[0] - 1):
        total, out = 0.0, np.zeros(g.shape)
        for part in (slice(0, k + 1), slice(k + 1, None)):
            gs, hs = g[part].sum(0), h[part].sum(0)
            gain, c = _cut(gs, hs, ridge)
            for cols in (slice(0, c + 1), slice(c + 1, None)) if c >= 0 else (slice(None),):
                v = gs[cols].sum() / (hs[cols].sum() + ridge)
                out[part, cols] = v
                total += gs[cols].sum() * v
        if total > best[0]:
            best = (total, out)
    return best


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 6, bins: int = 32, coarse: int = 8, rate: float = 0.1, ridge: float = 2.0) -> Additive:
    """Cyclic boosting of the tables, then of the pairs."""
    q = lambda n: [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    model = Additive(q(bins), q(coarse))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not len(y):
        return model
    model.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    at = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    z = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, t in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(at[f], g, len(t)), np.bincount(at[f], h, len(t)), 3, ridge)
            t += step
            z += step[at[f]]
    rough = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.coarse)]
    size = [len(e) + 1 for e in model.coarse]

    def grid(f: int, k: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(rough[f] * size[k] + rough[k], v, size[f] * size[k]).reshape(size[f], size[k])

    g, h = slopes()
    ranked = sorted(((-_square(grid(f, k, g), grid(f, k, h), ridge)[0], f, k) for f in range(x.shape[1]) for k in range(f + 1, x.shape[1])))
    model.pairs = {(f, k): np.zeros((size[f], size[k])) for _, f, k in ranked[:n_pairs]}
    for _ in range(pair_rounds):
        for (f, k), t in model.pairs.items():
            g, h = slopes()
            step = rate * _square(grid(f, k, g), grid(f, k, h), ridge)[1]
            t += step
            z += step[rough[f], rough[k]]
    return model


def held_out(id_col: str) -> Column:
    """The rows whose labels are never learned."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000) -> Additive:
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).alias("y"))
    some = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")  # at most `sample` small rows

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(features(b.column(1))), pa.list_(pa.float64())), b.column(2)], ["id", "x", "y"])

    small_batches(docs.sparkSession)
    kind = labels.schema[id_col].dataType.simpleString()
    rows = got.select("id", "text", "y").mapInArrow(each, f"id {kind}, x array<double>, y double").groupBy("id").agg(F.min("x").alias("x"), F.first("y").alias("y")).toPandas().sort_values("id")
    x = np.array(rows.x.tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, (rows.y.to_numpy(float) >= 0.5).astype(float))


def quality_classifier(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """id_col, held_out, score, predicted for every row of docs."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample=sample)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(features(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, held_out(id_col).alias("held_out"), text_col).mapInArrow(each, f"{id_col} {kind}, held_out boolean, score double, predicted int")
