import re

from lodestream.operators import chunking as C

TEXTS = {
    1: "First sentence here. Second one is a bit longer than that! Third? Yes. " * 6,
    2: "para one\nline two\n\npara two is here. And more words follow it.\n\n" + "x" * 150,
    3: "   \n ",
    4: "",
    5: "short",
    6: "the cat sat. the cat sat down. dogs run fast. dogs run very fast. The end is near.",
}


def frame(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")


def rows(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.document_id, r["index"])):
        assert r.chunk_id == f"{r.document_id}#{r['index']}"
        out.setdefault(r.document_id, []).append((r.start_char, r.end_char, r.content))
    return out


def located(text, parts):
    out, off = [], 0
    for p in parts:
        at = text.find(p, off)
        at = off if at < 0 else at
        out.append((at, at + len(p), p))
        off = max(off, at + 1)
    return out


def test_fixed(spark):
    got = rows(C.fixed_chunks(frame(spark), 50, 10))
    for d, t in TEXTS.items():
        want = [(p, min(p + 50, len(t)), t[p : p + 50]) for p in range(0, len(t), 40) if t[p : p + 50].strip()]
        assert got.get(d, []) == want


def test_sentence(spark):
    size, overlap, least = 80, 30, 5
    got = rows(C.sentence_chunks(frame(spark), size, overlap))
    for d, t in TEXTS.items():
        groups, cur, n = [], [], 0
        for s in [x.strip() for x in re.split(r"(?<=[.!?])\s+", t)]:
            if len(s) < least:
                continue
            more = len(s) + bool(cur)
            if cur and n + more > size:
                groups.append(" ".join(cur))
                keep, used = [], 0
                while cur and used + len(cur[-1]) + 1 <= overlap:
                    used += len(cur[-1]) + 1
                    keep.insert(0, cur.pop())
                cur, n = keep, sum(map(len, keep)) + max(0, len(keep) - 1)
            cur, n = [*cur, s], n + more
        groups += [" ".join(cur)] if cur else []
        assert got.get(d, []) == located(t, groups)


def test_semantic(spark):
    got = rows(C.semantic_chunks(frame(spark), 60, 0.3))
    for d, t in TEXTS.items():
        groups, before = [], None
        for s in [x.strip() for x in re.split(r"(?<=[.!?])\s+", t) if x.strip()]:
            bag = set(s.lower().split())
            near = before is not None and len(bag & before) / len(bag | before) >= 0.3
            if groups and near and len(groups[-1]) + 1 + len(s) <= 60:
                groups[-1] += " " + s
            else:
                groups.append(s)
            before = bag
        assert got.get(d, []) == located(t, groups)


def test_recursive(spark):
    got = rows(C.recursive_chunks(frame(spark), 60, 12))
    assert 3 not in got and 4 not in got and got[5] == [(0, 5, "short")]
    for d, chunks in got.items():
        assert all(len(c) <= 60 for _, _, c in chunks)
        bare = lambda t: {w.strip(".!?") for w in t.split()}  # noqa: E731  the separators between parts go
        assert bare(TEXTS[d]) <= bare(" ".join(c for _, _, c in chunks)) or d == 2
    assert C.split_recursive("a" * 25, 10) == ["a" * 10, "a" * 10, "a" * 5]
    assert C.merge_pieces(["aa", "bb", "cccccc"], 6, 2) == ["aa bb", "cccccc"]


def test_bad_sizes():
    import pytest

    for size, overlap in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            C.checked(size, overlap)


def test_semantic_of_odd_texts(spark):
    """White space is Unicode's, not Python's; a group stands where the text has it, later too, or where the search began."""
    texts = {
        1: "a b. a\x1cb. a b.\x85a b.",
        2: "a b.\na b.\na b. a b. a b.",
        3: "𐐀 cat sat. 𐐨 cat sat.\tⱯ Cat. ɐ cat.",
        4: "Ᲊ one. ᲊ one.",
    }
    got = rows(C.semantic_chunks(spark.createDataFrame([*texts.items(), (5, None)], "doc_id long, text string"), 9, 0.3))
    assert got[1] == [(0, 4, "a b."), (5, 9, "a\x1cb."), (6, 15, "a b. a b.")]
    assert got[2] == [(10, 19, "a b. a b."), (15, 24, "a b. a b."), (20, 24, "a b.")]
    assert [c for *_, c in got[3]] == ["𐐀 cat sat.", "𐐨 cat sat.", "Ɐ Cat.", "ɐ cat."]
    got = rows(C.semantic_chunks(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 60, 0.3))
    assert [c for *_, c in got[3]] == ["𐐀 cat sat. 𐐨 cat sat.", "Ɐ Cat. ɐ cat."] and len(got[4]) == 1
    bad = spark.sql("select 1L as doc_id, cast(x'61622e20ff62' as string) as text")
    assert [r.content for r in C.semantic_chunks(bad).collect()] == ["ab.", "�b"]


def test_semantic_of_a_long_text_takes_seconds(spark):
    """Similarities of all neighbours were taken anew for every sentence, and groups searched for from the start of the text."""
    import time

    text = "".join(f"the cat sat {i}.\nthe cat sat {i} too. " for i in range(40_000))
    start = time.perf_counter()
    got = C.semantic_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert time.perf_counter() - start < 40
    assert len(got) == 1 + max(r["index"] for r in got) and " ".join(r.content for r in sorted(got, key=lambda r: r["index"])).split() == text.split()
