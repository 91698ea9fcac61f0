import numpy as np
import pytest
from lodestream.llm.queries import RANKS
from lodestream.llm.token_counts import file_blocks, separator_scan, token_counts, tokenised

SEP = 50256


def brute(ids):
    out, n = [], 0
    for x in ids:
        if x == SEP:
            out.append((n, True))
            n = 0
        else:
            n += 1
    return out + ([(n, False)] if n else [])


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_files_equal_brute_force(spark, tmp_path, block):
    r = np.random.default_rng(1)
    files = [r.choice([1, 2, 3, SEP], 300, p=[0.4, 0.3, 0.2, 0.1]), np.array([SEP, SEP]), np.array([5]), np.array([], int), np.array([7] * 50 + [SEP])]
    for i, x in enumerate(files):
        (tmp_path / f"f{i}.bin").write_bytes(x.astype("<u2").tobytes())
    got = {}
    for row in token_counts(file_blocks(spark, str(tmp_path), block).repartition(3)).collect():
        got.setdefault(int(row.file.rsplit("f", 1)[1][:-4]), {})[row.place] = (row.n_tokens, row.ended)
    for i, x in enumerate(files):
        assert [v for _, v in sorted(got.get(i, {}).items())] == brute(x)
        assert sorted(got.get(i, {})) == list(range(len(brute(x))))


def test_documents(spark):
    import base64

    import tiktoken
    from lodestream.llm.token_counts import PATTERN

    with open(RANKS, "rb") as f:
        enc = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    texts = [None, "", " ", "hello <|endoftext|> world", "日本語 🙂", "x" * 3000] + [f"text number {i} " * i for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = separator_scan(tokenised(df, RANKS, block_bytes=64), extra="ids").collect()
    got = {d: n for r in rows for d, n in zip(r.extra, r.counts, strict=True)}
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert all(r.ended for r in rows)


def test_twice_and_empty(spark):
    b = spark.createDataFrame([("a", 0, b"\1\0"), ("a", 0, b"\1\0")], "file string, block long, data binary")
    with pytest.raises(Exception, match="twice"):
        token_counts(b).collect()
    assert token_counts(b.limit(0)).count() == 0
    assert [tuple(r) for r in token_counts(spark.createDataFrame([("a", 0, None)], "file string, block long, data binary")).collect()] == []
