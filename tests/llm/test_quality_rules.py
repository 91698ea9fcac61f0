import math
import random
import re
import string
from collections import Counter

import pyarrow as pa
from lodestream.llm import quality_rules as q

TEXTS = [None, "", " ", "\n", "a b c d e a b c d e\n\n a \na \n a", "x\x1cy z q   w", "é#é ‰", "one two three four five six seven eight nine ten", "u " * 500]


def brute(x):
    x = x or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    c = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    cov = {k for j in range(len(w) - 4) if c[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
    seen, dup = set(), 0
    for line in x.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(cov)


def test_measures_equal_brute_force():
    m = q.measure(pa.array(TEXTS, pa.string()))
    for i, x in enumerate(TEXTS):
        assert tuple(int(m[k][i]) for k in q.COLUMNS) == brute(x), x


def test_verdicts(spark):
    clean = "the cat and the dog ran to the house in the morning and it was a good day for all of them. " * 1
    rows = [(i, f"{clean} number {i} of many words that go on " + " ".join(f"w{i}x{j} and the" for j in range(80)), "en", 0) for i in range(40)]
    junk = " ".join(f"w{j}###" for j in range(200))
    rows += [(100, junk, "en", 0), (101, None, None, 0), (102, clean, "xx", 0), (103, "spam eggs ham beans toast " * 30, "en", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int").repartition(3)
    got = {r.doc_id: r for r in q.quality_rules(df).collect()}
    assert all(got[i].kept for i in range(40))
    assert not got[100].kept and not got[100].base_failed and got[100].char_distance > 0.25
    assert got[101].base_failed and got[101].n_words == 0 and not got[101].kept
    assert got[102].kept and got[102].char_distance is None
    assert got[103].base_failed
    assert {r.doc_id for r in q.kept_documents(df).collect()} == {*range(40), 102}
    assert q.quality_rules(df.limit(0)).count() == 0


def test_distance_bounds():
    import numpy as np

    p = np.array([[1, 0], [0, 1], [1, 1], [0, 0]])
    assert q.js_distance(p, np.array([[1, 0]] * 4)).round(6).tolist() == [0, 1, 0.557923, 0]


def distance(p, q):
    p, q = [x / max(sum(p), 1) for x in p], [x / max(sum(q), 1) for x in q]
    kl = lambda a: sum(x * math.log2(x / ((y + z) / 2)) for x, y, z in zip(a, p, q) if x > 0)
    return math.sqrt(max((kl(p) + kl(q)) / 2, 0)) if sum(p) else 0.0


def brute_histograms(text, lang):
    kind = lambda c: next((k for k, has in enumerate((c in string.ascii_lowercase, c in string.ascii_uppercase, c in string.digits, c in " \t\n\v\f\r", c in ".,;:!?'\"()-", c in string.punctuation, ord(c) < 128)) if has), 7)
    chars, common = [0] * 8, q.COMMON_WORDS[lang].split()
    for c in text:
        chars[kind(c)] += 1
    words = [0] * (max(len(x.split()) for x in q.COMMON_WORDS.values()) + 1)
    for w in re.findall(r"[^\x20\x09-\x0D]+", text):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
        words[common.index(w) if w in common else -1] += 1
    return chars, words


def test_distances_and_verdicts_equal_brute_force(spark):
    r = random.Random(9)
    rows = []
    for i in range(120):
        lang = r.choice(["en", "de", "fr"])
        odd = i % 20 == 7
        made = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(2, 9)))
        w = [r.choice(q.COMMON_WORDS[lang].split()) if r.random() < (0.05 if odd else 0.5) else (made().upper() + "##" if odd else made()) for _ in range(r.choice([5, 60, 200, 400]))]
        rows.append((i, " ".join(w * (5 if r.random() < 0.1 else 1)), lang))
    limits = q.DEFAULTS
    base = {i: brute(t) for i, t, _ in rows}
    fails = {i: b[0] < limits["min_words"] or 100 * b[4] > limits["max_repeat_percent"] * b[0] for i, b in base.items()}
    ref = {}
    for i, t, lang in rows:
        if not fails[i]:
            c, w = brute_histograms(t, lang)
            rc, rw = ref.setdefault(lang, ([0] * len(c), [0] * len(w)))
            ref[lang] = [x + y for x, y in zip(rc, c)], [x + y for x, y in zip(rw, w)]
    got = {x.doc_id: x for x in q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()}
    verdicts = set()
    for i, t, lang in rows:
        (c, w), (rc, rw) = brute_histograms(t, lang), ref[lang]
        cd = distance(c, rc) if sum(c) >= limits["min_chars"] else None
        wd = distance(w, rw) if base[i][0] >= limits["min_hist_words"] else None
        for have, want in ((got[i].char_distance, cd), (got[i].word_distance, wd)):
            assert (have is None) == (want is None) and (want is None or abs(have - want) < 1e-9)
        kept = not fails[i] and not (cd is not None and cd > limits["max_char_distance"]) and not (wd is not None and wd > limits["max_word_distance"])
        assert got[i].kept == kept and got[i].base_failed == fails[i]
        verdicts.add((kept, fails[i]))
    assert verdicts == {(True, False), (False, True), (False, False)}
