import random
import re
from itertools import accumulate
from operator import xor

from lodestream.llm.line_dedup import line_dedup, running_xor
from pyspark.sql import functions as F


def distance_at_most_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, min_words):
    lines = []
    for d, t in sorted((d, t) for d, t in rows if d is not None and t is not None):
        for p, line in enumerate(t.split("\n")):
            w = re.findall(r"[^\x20\x09-\x0D]+", line)
            if w:
                lines.append((d, p, w))
    lines.sort(key=lambda x: x[:2])
    gone = {}
    for i, (d, p, w) in enumerate(lines):
        for _, _, v in lines[:i]:
            if w == v or (len(w) >= min_words and len(v) >= min_words and distance_at_most_one(w, v)):
                gone.setdefault(d, []).append(p)
                break
    return gone


def test_removed_lines_equal_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(30)]
    base = [[r.choice(vocab) for _ in range(r.choice([1, 3, 8, 9, 10, 20]))] for _ in range(25)]
    rows = [(1000, None), (1001, ""), (1002, "\n \n"), (1003, "a\tb  c\r"), (1004, "a b c"), (None, "a b c")]
    for d in range(60):
        out = []
        for _ in range(r.randrange(1, 6)):
            w = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                i = r.randrange(len(w))
                k = r.randrange(3)
                if k == 0:
                    w[i] = r.choice(vocab)
                elif k == 1:
                    w.insert(i, r.choice(vocab))
                elif len(w) > 1:
                    del w[i]
            out.append(" ".join(w))
        rows.append((d, "\n".join(out)))
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, removed int").repartition(4)
    removed, docs = line_dedup(df)
    want = brute(rows, 8)
    assert {x.doc: x.removed for x in removed.collect()} == want
    got = {(x.doc_id, x.removed): x.text for x in docs.select(*df.columns).collect()}
    for i, (d, t) in enumerate(rows):
        keep = t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in want.get(d, []))
        assert got[d, i] == keep


def test_very_long_line_and_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    df = spark.createDataFrame([(1, long), (2, long + " x"), (3, long.replace("w7 ", "q "))], "doc_id long, text string")
    removed, _ = line_dedup(df)
    assert {x.doc: x.removed for x in removed.collect()} == {2: [0], 3: [0]}
    removed, docs = line_dedup(df.limit(0))
    assert removed.count() == 0 and docs.count() == 0


def test_cost_of_a_line_follows_its_length(spark):
    """200,000 words in one line: with a cost of their square this would take hours."""
    words = [f"w{i}" for i in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:150_000], "new", *words[150_000:]])), (3, " ".join([*words[:-9], "q", *words[-8:]])), (4, " ".join(["q", "r", *words[2:]]))]
    removed, _ = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc: x.removed for x in removed.collect()} == {2: [0], 3: [0]}


def test_running_xor(spark):
    r = random.Random(1)
    rows = [([r.getrandbits(62) for _ in range(n)],) for n in (1, 2, 3, 63, 64, 65, 1000)]
    for x in spark.createDataFrame(rows, "x array<long>").withColumn("y", running_xor(F.col("x"))).collect():
        assert x.y == list(accumulate(x.x, xor))


def test_rows_of_one_id_with_different_texts_keep_their_own_lines(spark):
    rows = [(1, "alpha beta gamma\nshared line here"), (5, "first a\nshared line here\nthird a"), (5, "first b\nonly in second row\nthird b"), (5, "first b\nonly in second row\nthird b")]
    _, docs = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert docs.columns == ["doc_id", "text"]
    want = [(1, rows[0][1]), (5, "first a\nthird a"), (5, rows[2][1]), (5, rows[3][1])]
    assert sorted((x.doc_id, x.text) for x in docs.collect()) == sorted(want)
