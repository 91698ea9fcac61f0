import numpy as np
import pytest
from lodestream.llm.embedding_dedup import audit_recall, embedding_dedup, shards

SCHEMA = "vec_id long, embedding array<float>, label int, node int"


def brute(rows, t=0.93):
    ok = {}
    for i, v, lab in rows:
        if v is not None and lab is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and np.any(v):
            v = np.asarray(v, np.float32).astype(float)
            ok[i] = (v / np.linalg.norm(v), lab)
    comp = {i: i for i, _, _ in rows}
    links = {i: 0 for i, _, _ in rows}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(ok)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if ok[i][1] == ok[j][1] and ok[i][0] @ ok[j][0] >= t:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                comp[y] = x
    return {i: (links[i], find(i)) for i in links}


def rows():
    r = np.random.default_rng(3)
    out, i = [], 0
    for lab in (0, 1, None):
        for _ in range(60):
            v = r.normal(size=16)
            for _ in range(int(r.choice([1, 1, 2, 5]))):
                out.append((i, (v + r.normal(size=16) * 0.08).astype(np.float32).tolist(), lab))
                i += 1
            out.append((i, out[-1][1], lab))
            i += 1
    v = r.normal(size=16)
    for _ in range(80):  # a large ball of near copies
        out.append((i, (v + r.normal(size=16) * 0.1).tolist(), 1))
        i += 1
    out += [(i, None, 1), (i + 1, [0.0] * 16, 1), (i + 2, [float("nan")] * 16, 1), (i + 3, [None] + [1.0] * 15, 1), (i + 4, [], 1), (i + 5, [float("inf")] * 16, 0)]
    return out


def test_links_and_components(spark):
    data = rows()
    df = spark.createDataFrame([(*x, 7) for x in data], SCHEMA).repartition(4)
    for limit in (1500, 60):  # one shard a label, and overlapping shards
        out = embedding_dedup(df, limit=limit)
        got = {x.vec_id: (x.n_links, x.component_id) for x in out.collect()}
        want = brute(data)
        assert set(got) == set(want)
        found = sum(min(got[i][0], want[i][0]) for i in want)
        assert found >= (0.99 if limit == 1500 else 0.9) * sum(n for n, _ in want.values())
        assert all(got[i][0] <= want[i][0] for i in want)
        if limit == 1500:
            assert np.mean([got[i] == want[i] for i in want]) > 0.97
            assert audit_recall(df, out, every=10).collect()[0].recall > 0.95


def test_empty_table(spark):
    assert embedding_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def clusters():
    """Two labels of far clusters of near clusters, pairs across cell borders, and a ball of unequal near copies."""
    r = np.random.default_rng(5)
    out = []
    for lab in (0, 1):
        for _ in range(5):
            far = r.normal(size=16)
            for _ in range(4):
                near = far + r.normal(size=16) * 0.25
                out += [(near + r.normal(size=16) * 0.2, lab) for _ in range(15)]
        out += [(r.normal(size=16), lab) for _ in range(20)]
    ball = r.normal(size=16)
    out += [(ball + r.normal(size=16) * 0.15, 1) for _ in range(150)]
    return [(i, v.astype(np.float32).tolist(), lab) for i, (v, lab) in enumerate(out)]


def test_split_path_equals_brute_force(spark):
    data = clusters()
    df = spark.createDataFrame([(*x, 7) for x in data], SCHEMA).repartition(4)
    unit = [(i, lab, (np.asarray(v) / np.linalg.norm(v)).tolist()) for i, v, lab in data]
    at = shards(spark.createDataFrame(unit, "node long, label int, v array<double>"), 20, 0.93)
    assert at.where("own").count() == len(data) and at.where("own").select("node").distinct().count() == len(data)
    assert max(r.shard.count(".") for r in at.collect()) > 1  # several levels
    out = embedding_dedup(df, limit=20)  # the ball is cut into blocks
    assert {r.vec_id: (r.n_links, r.component_id) for r in out.collect()} == brute(data)
    assert audit_recall(df, out, every=1).collect()[0].recall == 1.0


def test_registered_path_is_audited(spark, tmp_path, monkeypatch):
    import lodestream.llm.embedding_dedup as E
    from lodestream.llm.queries import op1_embedding_dedup
    from pyspark.sql import functions as F

    r = np.random.default_rng(9)
    ball = r.normal(size=16)
    data = [(i, (ball + r.normal(size=16) * 0.05).tolist(), 0, 7) for i in range(0, 600, 20)]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert op1_embedding_dedup(spark, str(tmp_path)).count() == len(data)
    whole = E.embedding_dedup
    monkeypatch.setattr(E, "embedding_dedup", lambda v: whole(v).withColumn("n_links", F.lit(1).cast("long")))
    with pytest.raises(RuntimeError):
        op1_embedding_dedup(spark, str(tmp_path))
    df = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    row = audit_recall(df, whole(df), every=20, queries=7).collect()[0]  # several blocks
    assert row.true_links == 30 * 29 and row.recall == 1.0
