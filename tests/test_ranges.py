import os
import random

import pytest
from lodestream.sources.ranges import ByteRanges


@pytest.fixture
def files(tmp_path):
    r = random.Random(1)
    out = {}
    for name, n in (("a.bin", 10_000), ("b.bin", 0), ("sub/c.bin", 4096), ("_hidden", 50)):
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(r.randbytes(n))
        if n and not name.startswith("_"):
            out[str(p)] = p.read_bytes()
    return f"{tmp_path}/in", out


def joined(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.file, r.at)):
        assert r.at == len(out.get(r.file, b"")) and r.at % 1000 == 0
        out[r.file] = out.get(r.file, b"") + bytes(r.data)
    return out


def test_one_file_is_read_by_several_tasks(spark, files):
    path, want = files
    spark.dataSource.register(ByteRanges)
    df = spark.read.format("byte_ranges").option("path", path).option("blockBytes", 1000).option("partitionBytes", 3000).load()
    assert df.rdd.getNumPartitions() == 4 + 2
    assert joined(df.collect()) == want
    one = spark.read.format("byte_ranges").option("blockBytes", 1000).load(f"file://{path}/a.bin")
    assert b"".join(bytes(r.data) for r in sorted(one.collect(), key=lambda r: r.at)) == want[f"{path}/a.bin"]


def test_stream_follows_growing_files(spark, files, tmp_path):
    path, want = files
    spark.dataSource.register(ByteRanges)

    def run(tail):
        s = spark.readStream.format("byte_ranges").option("path", path).option("blockBytes", 1000).option("tail", tail).load()
        q = s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(60)
        q.stop()
        return spark.read.parquet(f"{tmp_path}/out").collect()

    assert joined(run("false")) == {f: b[: len(b) // 1000 * 1000] for f, b in want.items()}
    with open(f"{path}/a.bin", "ab") as f:
        f.write(b"x" * 500)
    got = joined(run("true"))
    assert got[f"{path}/a.bin"] == want[f"{path}/a.bin"] + b"x" * 500 and got[f"{path}/sub/c.bin"] == want[f"{path}/sub/c.bin"]
    assert os.path.exists(f"{path}/_hidden")
