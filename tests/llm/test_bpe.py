import hashlib
import json
import random

import pytest
from lodestream.llm.bpe import Encoder, Vocabulary, bpe_decode, bpe_encode, merged
from lodestream.llm.queries import BYTES, QUERIES

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(BYTES)


def texts():
    r = random.Random(3)
    out = [None, "", " ", "\n\n  x", "don't 's I'LL we'll", "a<|endoftext|>b <|endoftext|><|endoftext|> c", "日本語 テスト 🙂🙂", "\x00\x1c\x1d a\x85b  c᠎", "a" * 5000, "՘࢏1\U000323b0 x"]
    letters = "abcdefgh   éß日本\n'0123.,!\t 🙂"
    return out + ["".join(r.choice(letters) for _ in range(r.randrange(1, 400))) for _ in range(200)] + ["word " * 60_000 + "end", "x1" * 150_000]


def by_scan(word, v):
    """Merges the leftmost pair of the best rank until none is left."""
    ids = [v.byte[c] for c in word]
    while True:
        best = min(((v.rank[a << 32 | b], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if a << 32 | b in v.rank), default=None)
        if best is None:
            return ids
        i = best[1]
        ids[i : i + 2] = [v.made[best[0]]]


def test_queue_equals_scan():
    v = Vocabulary(Vocabulary.read(BYTES))
    r = random.Random(1)
    for _ in range(1500):
        word = bytes(r.choice(b"aaabceinorst the\xc3\xa9") for _ in range(r.randrange(0, 30)))
        assert merged(word, v.byte, v.rank, v.made) == by_scan(word, v)


@pytest.mark.parametrize("special", [True, False])
def test_equals_the_library(spark, library, special):
    rows = list(enumerate(texts())) + [(1, ""), (None, "null id"), (None, "null id")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string").repartition(3)
    out = bpe_decode(bpe_encode(df, BYTES, special=special), BYTES, into="back").collect()
    library.encode_special_tokens = not special
    want = sorted(((str(i), tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in rows))
    library.encode_special_tokens = False
    assert sorted((str(r.doc_id), tuple(r.ids), r.back) for r in out) == want
    assert bpe_encode(df.limit(0), BYTES).count() == 0


def test_decode_of_any_ids(spark, library):
    r = random.Random(8)
    rows = [([r.randrange(50257) for _ in range(r.randrange(0, 40))],) for _ in range(200)] + [(None,), ([50256, 99999, -1, 5],)]
    df = spark.createDataFrame(rows, "ids array<int>")
    for skip in (False, True):
        got = [x.text for x in bpe_decode(df, BYTES, skip_special=skip).collect()]
        assert got == [None if x is None else library.decode([i for i in x if 0 <= i < 50257], skip_special_tokens=skip) for (x,) in rows]


def test_classes_of_later_unicode(library):
    e = Encoder(Vocabulary(Vocabulary.read(BYTES)))
    for c in ("՘", "₏", "\U00010940", "\U00012550", "\U0003d000", "\U000323b0", "Ᲊ"):
        s = f"a{c}1{c}!{c} {c}a"
        assert e.plain(s) == b"".join(i.to_bytes(4, "little") for i in library.encode(s).ids)


def test_other_vocabularies_are_refused():
    d = json.loads(Vocabulary.read(BYTES))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"added_tokens": [d["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError):
            Vocabulary(json.dumps(d | change))


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op13_bpe"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        mine = got[r.doc_id]
        assert mine.n_tokens == len(ids) and mine.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert mine.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
