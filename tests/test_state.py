"""Streams with state against their batch forms."""

import random
import time

from lodestream.operators import conversation as C
from lodestream.streaming.state import answers_within, drained, session_memory, with_state_store

SCHEMA = "conv_id long, turn long, role string, text string"


def test_replayed_batches_equal_the_whole_conversation(spark, tmp_path):
    r = random.Random(5)
    rows = [(c, t, "system" if t == 0 and c % 2 else r.choice(["user", "assistant"]), "w" * r.randrange(1, 90)) for c in range(12) for t in range(r.randrange(1, 14))]
    shuffled = r.sample(rows, len(rows))
    want = {tuple(x) for x in C.compact(spark.createDataFrame(rows, SCHEMA), 3, 60).select("conv_id", "turn", "role", "text").collect()}
    own = with_state_store(spark)
    for i in range(3):  # three micro-batches, in no order
        own.createDataFrame(shuffled[i::3], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = own.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = drained(session_memory(stream, 3, 60), f"{tmp_path}/out", f"{tmp_path}/cp").collect()
    last = {}
    for x in out:
        last[x.conv_id] = max(last.get(x.conv_id, 0), x.version)
    assert max(last.values()) == 3
    assert {(x.conv_id, x.turn, x.role, x.text) for x in out if x.version == last[x.conv_id] and x.turn is not None} == want


def test_answers_expire(spark, tmp_path):
    own = with_state_store(spark)

    def run(name, rows, ttl):
        own.createDataFrame(rows, "key string, request_id long, value string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
        stream = own.readStream.schema("key string, request_id long, value string").parquet(f"{tmp_path}/{name}/in")
        out = drained(answers_within(stream, ttl), f"{tmp_path}/{name}/out", f"{tmp_path}/{name}/cp", once=True)
        return {x.request_id: (x.hit, x.value) for x in out.collect()}

    first = [("a", 1, "x"), ("a", 2, "y"), ("b", 3, None), ("b", 4, "z")]
    assert run("long", first, 3_600_000) == {1: (False, "x"), 2: (True, "x"), 3: (False, None), 4: (False, "z")}
    assert run("long", [("a", 5, "new")], 3_600_000)[5] == (True, "x")
    assert run("short", first, 1000)[2] == (True, "x")
    time.sleep(1.5)
    assert run("short", [("a", 5, "new")], 1000)[5] == (False, "new")
