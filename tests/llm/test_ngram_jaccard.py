import random
import re

from lodestream.llm.ngram_jaccard import ngram_jaccard_join


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k=5):
    sets = {d: shingles(t, k) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed=1):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocab) for _ in range(60)]
    rows = [None, "", "  \n", "one two", "One  TWO", "one two three four", "a b c d e", "A b c d e"]
    for _ in range(60):
        base = [r.choice(vocab) for _ in range(r.choice([8, 30, 70, 300]))]
        if r.random() < 0.4:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        rows.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 3])):
            near = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                near[r.randrange(len(near))] = r.choice(vocab)
            rows.append(" ".join(near))
    base = [r.choice(vocab) for _ in range(120)]
    for _ in range(60):  # one large group of near copies, not all of which reach each other directly
        near = list(base)
        for _ in range(r.choice([1, 2, 3, 4])):
            near[r.randrange(len(near))] = r.choice(vocab)
        rows.append(" ".join(near))
    r.shuffle(rows)
    return list(enumerate(rows))


def test_components_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component string").repartition(5)
    members, links = ngram_jaccard_join(df)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in members.collect()}
    assert got == brute(rows)
    assert all(r.a < r.b for r in links.collect())


def test_empty_table(spark):
    members, links = ngram_jaccard_join(spark.createDataFrame([], "doc_id long, text string"))
    assert members.count() == 0 and links.count() == 0


def test_other_threshold(spark):
    from fractions import Fraction

    rows = [(1, "a b c d"), (2, "a b c e"), (3, "z y x w")]
    members, _ = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), k=1, threshold=Fraction(1, 2))
    assert {r.doc_id: r.component_id for r in members.collect()} == {1: 1, 2: 1, 3: 3}


def test_sketches_tell_long_sets_apart(spark):
    """Sizes and sketches let every pair through that reaches the threshold, and no pair of long sets that share half of their shingles."""
    from fractions import Fraction

    import numpy as np
    from lodestream.llm.ngram_jaccard import _similar, long_sketches, sketches
    from pyspark.sql import functions as F

    r = np.random.default_rng(3)
    rows = []

    def put(name, g):
        off = np.array([0, len(g)])
        rows.append((name, len(g), *map(int, sketches(g, off)[0]), next(x if x is None or isinstance(x, bytes) else x.tolist() for x in long_sketches(g, off))))

    want = set()
    for case, n in enumerate([40, 500, 512, 513, 1000, 1024, 1025, 2048, 5000]):
        base = r.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        put(f"{case}", base[:n])
        put(f"{case}near", base[n // 9 : n + n // 9])  # shares 8 / 9, at least 0.8 of the union
        put(f"{case}long", base[: n + n // 4])
        put(f"{case}half", base[n // 2 : n + n // 2])
        want |= {(f"{case}", f"{case}near"), (f"{case}", f"{case}long")}
    df = spark.createDataFrame(rows, ["name", "n", *(f"s{i}" for i in range(8)), "sk"])
    x, y = df.alias("x"), df.alias("y")
    got = {(p.a, p.b) for p in x.join(y, (F.col("x.name") < F.col("y.name")) & _similar(Fraction(4, 5))).select(F.col("x.name").alias("a"), F.col("y.name").alias("b")).collect()}
    assert want <= got
    assert not {p for p in got if p[1].endswith("half")}


def test_long_texts_that_share_passages_equal_brute_force(spark):
    r = random.Random(5)
    word = lambda: f"v{r.randrange(10**6)}"
    passage = [word() for _ in range(900)]
    rows = []
    for _ in range(12):
        own = [word() for _ in range(r.choice([150, 250, 600]))]
        base = own[:100] + passage + own[100:]
        rows.append(" ".join(base))
        for changes in (1, 10, 40):
            near = list(base)
            for _ in range(changes):
                near[r.randrange(len(near))] = word()
            rows.append(" ".join(near))
    rows = list(enumerate(rows))
    members, _ = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {m.doc_id: (m.n_shingles, m.component_id) for m in members.collect()} == brute(rows)
