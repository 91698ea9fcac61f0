"""Simhash rows against one gram at a time."""

import hashlib
import random
import time

from lodestream.operators import dedup as D


def one_by_one(*texts):
    votes = [0] * 64
    for t in texts:
        for g in {t[i : i + 3] for i in range(len(t) - 2)} or {t} - {""}:
            x = int.from_bytes(hashlib.md5(g.encode()).digest()[8:], "big")
            votes = [v + (1 if x >> i & 1 else -1) for i, v in enumerate(votes)]
    x = sum(1 << i for i, v in enumerate(votes) if v > 0)
    return x >> 32, x & 0xFFFFFFFF


def test_odd_texts(spark):
    r = random.Random(5)
    texts = {1: "", 2: "a", 3: "ab", 4: "abc", 5: "aaaaaa", 6: "𐐨𐐩 𐐪日本語 straße", 7: "".join(r.choice("abcdefgh ") for _ in range(3000))}
    texts = {k: " ".join(t.split()) for k, t in texts.items()}
    rows = [*texts.items(), (8, None), (9, "first row of a key"), (9, "and the second")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.hi, x.lo) for x in D.simhash_rows(df).collect()}
    assert got == {k: one_by_one(t) for k, t in texts.items()} | {8: (0, 0), 9: one_by_one(*(t for k, t in rows if k == 9))}


def test_stretches_and_forgotten_grams(monkeypatch):
    r = random.Random(6)
    texts = ["".join(r.choice("abcdefghij") for _ in range(n)) for n in (0, 1, 2, 3, 17, 18, 19, 400)]
    want = [one_by_one(t) for t in texts]
    monkeypatch.setattr(D, "STRETCH", 16)
    monkeypatch.setattr(D, "KNOWN", 50)
    votes = D.Votes()
    for _ in range(2):
        for n in (1, 3, len(texts)):
            each = [votes.of([D.grams(t) for t in texts[i : i + n]]) for i in range(0, len(texts), n)]
            got = [sum(1 << 63 - i for i, v in enumerate(row) if v > 0) for rows in each for row in rows]
            assert [(x >> 32, x & 0xFFFFFFFF) for x in got] == want


def test_a_long_text_takes_seconds(spark):
    """Grams cut one by one from the start of the text took the square of its length."""
    r = random.Random(7)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.perf_counter()
    (row,) = D.simhash_rows(df).collect()
    assert time.perf_counter() - start < 30
    assert (row.hi, row.lo) == one_by_one(text)


def test_each_near_pair_comes_once(spark, monkeypatch):
    from lodestream.operators import greedy as G

    r = random.Random(8)
    seeds, found = [r.getrandbits(64) for _ in range(5)], []
    near = lambda x: x ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 2)))
    values = list(dict.fromkeys(near(r.choice(seeds)) for _ in range(120)))
    monkeypatch.setattr(G, "stays", lambda pairs, stays=G.stays: (found.extend(tuple(p) for p in pairs.collect()), stays(pairs))[1])
    G.greedy_simhash(spark.createDataFrame([(i, x >> 32, x & 0xFFFFFFFF) for i, x in enumerate(values)], "doc_id long, hi long, lo long"))
    assert sorted(found) == [(i, j) for i, x in enumerate(values) for j, y in enumerate(values) if i < j and (x ^ y).bit_count() <= 3]
