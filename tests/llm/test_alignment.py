import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from lodestream.llm.alignment import align, components, cross_tokenizer_alignment
from lodestream.llm.queries import BYTES, PIECES, QUERIES

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")


def byte_letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class Brute:
    def __init__(self):
        self.a = tokenizers.Tokenizer.from_file(BYTES)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        self.of = byte_letters()

    def tokens(self, text):
        """(id, bytes) on both sides; nothing where the bytes differ from the space and the text."""
        if not text:
            return [], []
        a = [(i, bytes(self.of[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()))
        told = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == told == b"".join(x for _, x in b) else ([], [])

    def rows(self, texts):
        docs = []
        for text in texts:
            a, b = self.tokens(text)
            spans = []
            for side in (a, b):
                at, out = 0, []
                for _, x in side:
                    out.append((at, at + len(x)))
                    at += len(x)
                spans.append(out)
            links, j = [], 0
            for i, (s, e) in enumerate(spans[0]):
                while spans[1][j][1] <= s:
                    j += 1
                k = j
                while k < len(b) and spans[1][k][0] < e:
                    links.append((i, k))
                    k += 1
            cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
            groups = []
            for cut in cuts:
                start = groups[-1][0] if groups else 0
                groups.append((cut, [i for (i, _), (s, e) in zip(a, spans[0]) if start <= s and e <= cut], [i for (i, _), (s, e) in zip(b, spans[1]) if start <= s and e <= cut]))
            docs.append(([x for x, _ in a], [x for x, _ in b], [(x, y) for _, x, y in groups], [(a[i][0], b[k][0]) for i, k in links]))
        count = Counter(p for *_, links in docs for p in set(links))
        best = {}
        for (x, _), n in count.items():
            best[x] = max(best.get(x, 0), n)
        out = []
        for a, b, groups, links in docs:
            told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            out.append((len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(told.encode()).hexdigest() if a else ""))
        return out, {p: (n, n == best[p[0]]) for p, n in count.items()}


def texts():
    r = random.Random(4)
    letters = "abcdefgh   éß日本語のтест\n'0123.,!\t🙂"
    out = [None, "", " ", "  two  spaces", "a▁b", "▁", "<s> <|endoftext|> <unk> <0x0A>", "x\x00y", "日本語のテスト", "🙂🙂🙂", "internationalisation isn't"]
    out += ["".join(r.choice(letters) for _ in range(r.randrange(1, 120))) for _ in range(60)]
    return out + ["the same text twice, here"] * 3


def test_documents_and_pairs_equal_brute_force(spark):
    ts = texts()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(ts)] + [(None, "null id", 1, 2)], "doc_id long, text string, n_a int, block int").repartition(3)
    documents, pairs = cross_tokenizer_alignment(df, BYTES, PIECES)
    want, count = Brute().rows([*ts, "null id"])
    got = {r.doc_id: r for r in documents.collect()}
    for i, w in enumerate(want):
        r = got[i if i < len(ts) else None]
        assert r.n_groups == (r.groups.count(";") + 1 if r.groups else 0)
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "") == w, ts[i : i + 1]
    assert {(r.a, r.b): (r.documents, r.best) for r in pairs.collect()} == count


def test_long_text_in_stretches_and_repeated_rows(spark):
    r = random.Random(9)
    long = " ".join("".join(r.choice("abcdeinorst日é") for _ in range(r.randrange(1, 9))) for _ in range(60_000))
    df = spark.createDataFrame([(1, long), (2, long), (2, long), (3, "ab" * 1000)], "doc_id long, text string")
    documents, _ = cross_tokenizer_alignment(df, BYTES, PIECES)
    want, _ = Brute().rows(["ab" * 1000])
    got = sorted((x.doc_id, x.n_a, x.n_b, x.n_groups, x.n_links) for x in documents.collect())
    assert got[0][1:] == got[1][1:] == got[2][1:] and got[3][1:] == want[0][:4]
    b = Brute()
    a, c = b.tokens(long)
    ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (a, c)]
    assert got[0][3] == len(ends[0] & ends[1])
    assert got[0][1:3] == (len(a), len(c)) and got[0][4] == len(a) + len(c) - got[0][3]  # a group is a tree


def test_empty_table(spark):
    documents, pairs = cross_tokenizer_alignment(spark.createDataFrame([], "doc_id long, text string"), BYTES, PIECES)
    assert documents.count() == 0 and pairs.count() == 0


def test_components_and_align():
    r = np.random.default_rng(0)
    for _ in range(100):
        total = int(r.integers(1, 60))
        cuts = [np.diff(np.concatenate([[0], np.sort(r.choice(np.arange(1, total), int(r.integers(0, total)), replace=False)), [total]])) for _ in range(2)]
        x = align(*cuts)
        ends = [np.cumsum(c) for c in cuts]
        starts = [e - c for e, c in zip(ends, cuts)]
        links = {(i, j) for i in range(len(cuts[0])) for j in range(len(cuts[1])) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]}
        assert set(zip(x.link_a.tolist(), x.link_b.tolist())) == links and len(x.link_a) == len(links)
        assert len(set(x.of_a.tolist())) == len(set(ends[0].tolist()) & set(ends[1].tolist()))
    chain = np.arange(999, dtype=np.int32)
    assert (components(1000, chain[::-1].copy(), chain[::-1] + np.int32(1)) == 0).all()


def test_scanned_words_equal_the_queue():
    from lodestream.llm.alignment import SCANNED, Scanned
    from lodestream.llm.bpe import Vocabulary, merged

    with open(BYTES, encoding="utf-8") as f:
        v = Vocabulary(f.read())
    enc, r = Scanned(v), random.Random(6)
    words = [b"", b"a", b" the", b"aaaaaaaaaaaaaaaa", *(bytes(r.randrange(256) for _ in range(r.randrange(1, SCANNED + 1))) for _ in range(500))]
    words += ["".join(r.choice(" aehinorst'é日") for _ in range(r.randrange(1, 11))).encode() for _ in range(5000)]
    for w in words:
        assert enc.scanned(w) == merged(w, v.byte, v.rank, v.made)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text) < 3000]
    got = {r.doc_id: r for r in QUERIES["op11_alignment"](spark, sf).collect()}
    b = Brute()
    for i, text in docs[:60]:
        a, c = b.tokens(text)
        want, _ = b.rows([text])
        assert (got[i].n_a, got[i].n_b, got[i].n_groups, got[i].n_links, got[i].groups_sha256) == (*want[0][:4], want[0][6])


def test_kept_words_are_bounded_and_frequent_ones_stay(monkeypatch):
    """Words that a worker keeps: no more than two generations on each side, with the same ids as without."""
    from lodestream.llm import alignment
    from lodestream.llm.bpe import Vocabulary

    monkeypatch.setattr(alignment, "RECENT_WORDS", 16, raising=False)
    with open(PIECES, "rb") as f:
        s = alignment.Sides(Vocabulary.read(BYTES), f.read())
    brute, rng = Brute(), random.Random(5)
    texts = [" ".join(["often", *("".join(rng.choices("abcdefghij", k=6)) for _ in range(7))]) for _ in range(100)] + ["a\u2581b often", "x" * 200]
    for k in range(0, len(texts), 10):
        s.b.prepare(texts[k : k + 10])
        for text in texts[k : k + 10]:
            a, b = s.encode(text) or ([], [])
            assert ([*a], [*b]) == tuple([i for i, _ in side] for side in brute.tokens(text))
            for side in (s.a, s.b):
                assert len(side) + len(side.old) <= 32
    assert all(any("often" in w for w in (*side, *side.old)) for side in (s.a, s.b))


def test_tokens_are_not_shuffled(spark):
    """The packed texts stay in their buckets: only counts of pairs are exchanged."""
    docs = spark.createDataFrame([(k, f"some words of text {k}") for k in range(20)], "doc_id long, text string")
    plan = cross_tokenizer_alignment(docs, BYTES, PIECES)[0]._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("hashpartitioning(block#" in line for line in exchanges), plan


def test_words_scanned_together_equal_the_queue():
    from lodestream.llm.alignment import SCANNED, Scanned
    from lodestream.llm.bpe import Vocabulary, merged

    with open(BYTES, encoding="utf-8") as f:
        v = Vocabulary(f.read())
    enc, r = Scanned(v), random.Random(8)
    words = [b"", b"a", b" the", b"aaaaaaaaaaaaaaaa", *(bytes(r.randrange(256) for _ in range(r.randrange(1, SCANNED + 1))) for _ in range(500))]
    words += ["".join(r.choice(" aehinorst'é日") for _ in range(r.randrange(1, 11))).encode() for _ in range(3000)]
    assert [np.frombuffer(x, np.int32).tolist() for x in enc.scanned_all(words)] == [merged(w, v.byte, v.rank, v.made) for w in words]
    assert enc.scanned_all([]) == [] and enc.scanned_all([b"", b"x"])[0] == b""


def test_kept_chunks_are_not_cut_again(monkeypatch):
    """A text of known chunks is put together from them; its pattern is not run again, and white space is cut as in the whole text."""
    from lodestream.llm import alignment
    from lodestream.llm.bpe import Encoder, Vocabulary

    with open(PIECES, "rb") as f:
        s = alignment.Sides(Vocabulary.read(BYTES), f.read())
    brute, r = Brute(), random.Random(11)
    letters = [*"ab'sé日1!", " ", " ", " ", "\n", "\t", "　", "\x1c", "\x85", "\xa0", "₏"]
    texts = ["a b, c\n d"] + ["".join(r.choice(letters) for _ in range(r.randrange(1, 20))) for _ in range(1500)]
    for prepared in (False, True):
        for t in texts:
            if prepared:
                s.a.prepare([t])
            a, b = s.encode(t) or ([], [])
            assert ([*a], [*b]) == tuple([i for i, _ in side] for side in brute.tokens(t)), t
    cut = []
    plain = Encoder.plain
    monkeypatch.setattr(Encoder, "plain", lambda self, text: cut.append(text) or plain(self, text))
    s.encode("some words, and some more of them.")
    cut.clear()
    assert s.encode("some more words, and more of them.") is not None and cut == []
