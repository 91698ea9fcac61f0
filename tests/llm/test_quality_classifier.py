import math
import random
import re
import zlib

import numpy as np
from lodestream.llm.quality_classifier import FEATURES, features, fit, quality_classifier

from test_quality_rules import brute


def test_tables_and_pairs_learn_an_interaction():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = fit(x[:2000], y[:2000], rounds=30)
    assert (0, 1) in m.pairs
    assert ((m.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9


def test_held_out_accuracy(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeors") for _ in range(r.randrange(2, 8)))
    rows, labels = [(-1, None), (-2, ""), (-3, " \n")], [(-1, None), (5000, 1)]
    for i in range(400):
        w = [word() for _ in range(r.randrange(8, 120))]
        good = r.random() < 0.6
        rows.append((i, " ".join(w) + "." if good else " ".join(x.upper() + "!!" if i % 2 else x + "###" for x in w)))
        if i % 5:
            labels.append((i, int(good)))
    d = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, score int").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    out = {x.doc_id: x for x in quality_classifier(d, lab).collect()}
    assert len(out) == len(rows)
    truth = dict(labels)
    for i, x in out.items():
        assert x.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7)
    test = [i for i in out if out[i].held_out and truth.get(i) is not None]
    assert len(test) > 40 and np.mean([out[i].predicted == truth[i] for i in test]) > 0.97
    assert len({out[i].score for i in (-1, -2, -3)}) == 1
    none = quality_classifier(d, lab.limit(0)).select("score").distinct().collect()
    assert [x.score for x in none] == [0.5]
    assert quality_classifier(d.limit(0), lab).count() == 0


def test_features_of_nothing_are_zero():
    import pyarrow as pa

    assert features(pa.array([None, "", "\t"], pa.string())).shape == (3, len(FEATURES))
    assert not features(pa.array([None, "", "\t"], pa.string())).any()


def slow_features(text):
    from lodestream.llm.quality_rules import COMMON_WORDS

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), max(len(text), 1)
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    share = lambda f: sum(map(f, text)) / chars
    _, word_chars, _, dup, repeat = brute(text)
    common = {w for v in COMMON_WORDS.values() for w in v.split()}
    upper = lambda c: "A" <= c <= "Z"
    marks, symbols = ".,;:!?'\"()-", "#*$%&|<>"
    return [
        math.log1p(n), word_chars / n, share(upper), share(str.isdecimal), share(lambda c: c in marks), share(lambda c: c in symbols),
        share(lambda c: ord(c) < 128 and not (c.isalnum() or c in " \t\n\v\f\r" + marks + symbols)), share(lambda c: ord(c) >= 128),
        text.count("!") / n, text.count("|") / n, dup / n, repeat / n, len(set(low)) / n, math.log1p(max(len(w.encode()) for w in words)),
        sum(w in common for w in low) / n, sum(w[-1] in "!#*$%&|<>" for w in words) / n, text.count("\n") / n,
        sum(upper(w[0]) and len(w) > 1 and upper(w[1]) for w in words) / n,
    ]


def test_features_and_scores_equal_slow_arithmetic():
    import pyarrow as pa

    r = random.Random(8)
    texts = [None, "", "A", "A B", "É! x", " \n\n a", "a\tb|c<d> 12,5 @home~", "the THE The\nthe THE The\n"]
    for _ in range(60):
        w = ["".join(r.choice("abcXYZé019.,!#@|") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 80))]
        texts.append("".join(x + r.choice([" ", " ", " ", "\n", "  "]) for x in w * r.choice([1, 1, 3])))
    x = features(pa.array(texts, pa.string()))
    for row, t in zip(x, texts):
        assert np.allclose(row, slow_features(t), atol=1e-12), t
    y = np.array([len(t or "") % 2 for t in texts], float)
    m = fit(x, y, rounds=5, pair_rounds=3)
    place = lambda e, v: sum(v >= k for k in e)
    for row, s in zip(x, m.score(x)):
        z = m.bias + sum(t[place(m.edges[f], row[f])] for f, t in enumerate(m.tables))
        z += sum(t[place(m.coarse[f], row[f]), place(m.coarse[k], row[k])] for (f, k), t in m.pairs.items())
        assert abs(s - 1 / (1 + math.exp(-z))) < 1e-12


def test_null_and_repeated_ids_are_scored(spark):
    docs = spark.createDataFrame([(None, "some text here"), (7, "some text here"), (7, "OTHER TEXT ###"), (8, "w " * 300_000)], "doc_id long, text string")
    out = quality_classifier(docs, spark.createDataFrame([(7, 1)], "doc_id long, quality int")).collect()
    assert len(out) == 4 and all(0 <= x.score <= 1 for x in out)
    assert [x.held_out for x in out if x.doc_id is None] == [False]
