import os
import random
import struct
import subprocess
import sys

import pytest
from lodestream.llm.sentencepiece_lattice import MARK, Model, by_queue, sentencepiece_decode, sentencepiece_encode

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(num, value):
    if isinstance(value, int):
        return varint(num << 3) + varint(value)
    return varint(num << 3 | 2) + varint(len(value)) + value


def unigram(path, pieces):
    """A hand-made unigram model: no tokenizer is trained."""
    raw = b"".join(field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + field(3, t)) for p, s, t in pieces)
    raw += field(2, field(3, 1) + field(40, 0)) + field(3, field(1, b"identity") + field(2, b"") + field(3, 1) + field(4, 0) + field(5, 1))
    path.write_bytes(raw)
    return str(path)


def texts():
    r = random.Random(5)
    out = [None, "", " ", "  two  spaces ", "a\nb\tc\r\n", "日本語 テスト 🙂 ▁x", "x\x01y", "Hello world, the lattice!", "é" * 90, "a" * 200, "▁▁", "<s> </s> <0x0A>", "é日ab" * 1500]
    for _ in range(150):
        out.append(" ".join("".join(r.choice("abcdeinorst") for _ in range(r.randrange(1, 14))) for _ in range(r.randrange(1, 12))))
    return out


def test_bpe_equals_the_library(spark):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, w int").repartition(3)
    out = sentencepiece_encode(df, MODEL, frequent=50)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        if t is None:
            assert got[i].ids is None
        else:
            assert got[i].ids == sp.encode(t), t
            assert got[i].round_trip
    back = sentencepiece_decode(out.select("doc_id", "ids"), MODEL)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t if t is None else t.replace(MARK, " ") for i, t in rows}
    assert sentencepiece_encode(df.limit(0), MODEL).count() == 0


def test_unigram_viterbi_equals_the_library(spark, tmp_path):
    spm = pytest.importorskip("sentencepiece")
    r = random.Random(2)
    made = sorted({"".join(r.choice("abc▁") if k == 0 else r.choice("abc") for k in range(r.randrange(1, 5))) for _ in range(60)} | {"▁", "a", "b", "c"})
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(p, -r.uniform(1, 12), 1) for p in made]
    path = unigram(tmp_path / "u.model", pieces)
    sp = spm.SentencePieceProcessor(model_file=path)
    rows = [(i, " ".join("".join(r.choice("abcd") for _ in range(r.randrange(1, 9))) for _ in range(3))) for i in range(60)]
    rows += [(60, "".join(r.choice("abcd") for _ in range(600)))]
    out = sentencepiece_encode(spark.createDataFrame(rows, "doc_id long, text string"), path, frequent=5)
    got = {x.doc_id: x.ids for x in out.collect()}
    for i, t in rows:
        assert got[i] == sp.encode(t), t


def test_queue_takes_best_rank_leftmost():
    edges = [(k, s, s + n, k) for n, k in ((1, 9), (2, 0)) for s in range(6 - n)]
    assert [x[:2] for x in by_queue(5, edges)] == [(0, 2), (2, 4), (4, 5)]


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        Model.read(field(1, field(1, b"<unk>") + field(3, 2)) + field(3, field(2, b"map")))


HOLDING = """
import random, re, sys, pyarrow as pa
sys.path.insert(0, sys.argv[1])
from lodestream.llm.sentencepiece_lattice import Cutter, Model, blocks
from lodestream.llm.queries import PIECES
cutter, rng = Cutter(Model.read(open(PIECES, "rb").read())), random.Random(3)

def held():
    return sum(map(int, re.findall(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    for _ in range(8):
        yield pa.record_batch({"text": [" ".join("%x" % rng.getrandbits(40) for _ in range(400)) for _ in range(250)]})

before = held()
for b in blocks(batches(), 0, 4 << 20):
    words = cutter.words(b.column(0))[2]
    cutter.units(words)[1].to_pylist()
    del b, words
print(held() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="reads /proc")
def test_a_worker_gives_back_what_its_blocks_took():
    """A Python worker that has done its blocks stays for other tasks: it holds little more than before them."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", HOLDING, root], capture_output=True, text=True, check=True).stdout
    assert float(out) < 15, out
