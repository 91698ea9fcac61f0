"""Near-duplicates of a corpus against the sequential pass."""

import random

from lodestream.operators.greedy import greedy_minhash, greedy_simhash, stays


def sequential(rows, near):
    kept, out = [], {}
    for key, x in sorted(rows):
        home = next((k for k, y in kept if near(x, y)), None)
        if home is None:
            kept.append((key, x))
        out[key] = key if home is None else home
    return out


def flipped(r, x, n, bits=64):
    for b in r.sample(range(bits), n):
        x ^= 1 << b
    return x


def test_simhash_equals_the_sequential_rule(spark):
    r = random.Random(7)
    seeds = [r.getrandbits(64) for _ in range(25)] + [0, (1 << 64) - 1]
    values = [flipped(r, r.choice(seeds), r.choice([0, 0, 1, 2, 2, 3])) for _ in range(500)]
    rows = list(enumerate(values))
    df = spark.createDataFrame([(i, x >> 32, x & 0xFFFFFFFF) for i, x in rows], "doc_id long, hi long, lo long").repartition(5)
    for limit in (3, 1):
        got = {x.doc_id: x.kept_as for x in greedy_simhash(df, limit=limit).collect()}
        assert got == sequential(rows, lambda x, y: (x ^ y).bit_count() <= limit)
    assert greedy_simhash(df.limit(0)).count() == 0


def test_minhash_equals_the_sequential_rule(spark):
    r = random.Random(8)
    seeds = [[r.getrandbits(32) for _ in range(32)] for _ in range(12)]

    def near_copy():
        x = list(r.choice(seeds))
        for i in r.sample(range(32), r.choice([0, 1, 3, 5, 6, 7])):
            x[i] = r.getrandbits(32)
        return x

    rows = [(i, near_copy()) for i in range(250)]
    df = spark.createDataFrame(rows, "doc_id long, signature array<long>").repartition(3)
    got = {x.doc_id: x.kept_as for x in greedy_minhash(df, seeds=32).collect()}
    assert got == sequential(rows, lambda x, y: sum(a == b for a, b in zip(x, y)) / 32 >= 0.8)


def test_chains_take_rounds(spark):
    pairs = [(i, i + 1) for i in range(9)] + [(2, 5), (4, 11), (3, 11)]
    got = {x.node: x.kept_as for x in stays(spark.createDataFrame(pairs, "a long, b long")).collect()}
    near = set(pairs)
    want = sequential([(i, i) for i in range(12)], lambda x, y: (y, x) in near)
    assert got == {k: v for k, v in want.items() if k != v}
