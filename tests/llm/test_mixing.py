from collections import Counter

import pytest

from lodestream.llm.mixing import mix_sources, schedule, shares


def test_schedule_stays_within_one_block():
    share = shares({"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}, 60)
    seen = Counter()
    for t, s in enumerate(schedule(share) * 3, 1):
        seen[s] += 1
        assert all(abs(seen[x] - t * a / 60) < 1 for x, a in share.items())


def test_mix(spark):
    rows = [(i, "a" if i % 3 else ("b" if i % 2 else None), i) for i in range(600)] + [(5, "a", 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, mix int").repartition(3)
    w = {"a": 0.5, "b": 0.3, None: 0.2}
    out = mix_sources(df, w, block=4, period=10).orderBy("mix_position").collect()
    assert len({r.mix_position for r in out}) == len(out)
    assert {(r.doc_id, r.source) for r in out} == {(i, s) for i, s, _ in rows}
    assert Counter((r.doc_id, r.source) for r in out if r.mix_epoch == 0)[5, "a"] == 2
    seen = Counter()
    blocks = [{r.source for r in out if r.mix_position // 4 == t} for t in range(out[-1].mix_position // 4 + 1)]
    for t, b in enumerate(blocks, 1):
        (s,) = b
        seen[s] += 1
        assert all(abs(seen[x] - t * y) < 1 for x, y in w.items())
    again = mix_sources(df.repartition(7), w, block=4, period=10).orderBy("mix_position").collect()
    assert [r.doc_id for r in again] == [r.doc_id for r in out]


def test_empty_and_missing_weight(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, source string")
    assert mix_sources(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mix_sources(df, {"b": 1.0})


def test_exact_weights_and_many_sources(spark):
    sizes = {"a": 9001, "b": 2003, "c": 997, "d": 13}  # weights that no thousandths hold
    df = spark.createDataFrame([(i, s) for s, k in sizes.items() for i in range(k)], "doc_id long, source string").repartition(3)
    got = mix_sources(df, block=1, period=10).orderBy("mix_position").collect()  # in several stretches
    assert [r.mix_position for r in got] == list(range(len(got)))
    assert Counter(r.source for r in got if r.mix_epoch == 0) == sizes
    total, seen = sum(sizes.values()), Counter()
    for t, r in enumerate(got, 1):
        seen[r.source] += 1
        assert all(abs(seen[s] - t * (0.8 * k / total + 0.05)) < 1 + 1e-9 for s, k in sizes.items())
    many = spark.createDataFrame([(i, f"s{i % 1203}") for i in range(2500)], "doc_id long, source string")
    out = mix_sources(many)
    assert out.where("mix_epoch = 0").select("doc_id").distinct().count() == 2500
    assert out.select("mix_position").distinct().count() == out.count()


def test_rows_without_an_id_are_dealt_over_buckets(spark):
    df = spark.createDataFrame([(None, "a", f"text {i}", {"k": i}) for i in range(3000)] + [(1, "b", "x", {"k": 0})], "doc_id long, source string, text string, meta map<string,int>").repartition(3)
    out = mix_sources(df)
    assert out.columns == [*df.columns, "mix_position", "mix_epoch"]
    got = out.where("source = 'a' and mix_epoch = 0").collect()
    assert len({r.text for r in got}) == 3000 and len({r.mix_position for r in got}) == 3000


def test_positions_equal_brute_force(spark):
    from fractions import Fraction
    from math import ceil, floor

    from pyspark.sql import functions as F

    sizes = {"a": 1500, "b": 37, None: 200}
    rows = [(i + 10_000 * k, s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(3)
    block, weights = 8, {"a": 0.6, "b": 0.1, None: 0.3}
    per = 1024
    keyed = df.select("doc_id", "source", F.xxhash64(F.lit(17), "doc_id", "source").alias("h")).collect()
    order = {s: [x.doc_id for x in sorted((x for x in keyed if x.source == s), key=lambda x: (x.h % max(1, ceil(n / per)), x.h, x.doc_id))] for s, n in sizes.items()}
    w = {s: Fraction(str(x)) for s, x in weights.items()}
    names = sorted(w, key=lambda s: (s is not None, str(s)))
    used, slot, want = dict.fromkeys(w, 0), 0, {}
    while any(used[s] < ceil(n / block) for s, n in sizes.items()):
        s = min((x for x in names if floor(used[x] / w[x]) <= slot), key=lambda x: (ceil((used[x] + 1) / w[x]), names.index(x)))
        for i in range(block):
            k = used[s] * block + i
            want[slot * block + i] = (order[s][k % sizes[s]], s, k // sizes[s])
        used[s] += 1
        slot += 1
    got = {x.mix_position: (x.doc_id, x.source, x.mix_epoch) for x in mix_sources(df, weights, block=block).collect()}
    assert set(got) <= set(want) and all(want[p] == v for p, v in got.items())
    assert all(s == "a" or e >= 0 for _, s, e in got.values()) and len({d for d, _, e in got.values() if e == 0}) == len(rows)
