"""Keyed state over streams: bounded session memory and answers that expire.

Both need Spark's RocksDB state store (`with_state_store`). State is kept by Spark: it survives lost executors with the query's
checkpoint, and its size a key is bounded by the limits below.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.text import token_estimate
from ..operators.tables import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MESSAGE = "turn long, role string, text string, tokens long"


def with_state_store(spark: SparkSession) -> SparkSession:
    """A session of its own whose streams keep their state in RocksDB; the caller's settings stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return own


class Memory(StatefulProcessor):
    """All system messages and the last 2 * max_turns others, without the oldest of these while the tokens are above the limit.

    What is driven out stays out, as later messages only add turns and tokens, and so does all that is older: the newest turn that was
    driven out is part of the state. So the memory is the same in whatever batches and order the messages come, and equals that of the
    whole conversation.
    """

    def __init__(self, max_turns: int, max_tokens: int) -> None:
        self.max_turns, self.max_tokens = max_turns, max_tokens

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", MESSAGE)
        self.past = handle.getValueState("past", "batches long, gone long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        messages = [tuple(x) for x in self.kept.get()]
        for pdf in rows:
            messages += list(zip(pdf.turn.tolist(), pdf.role.tolist(), pdf.text.tolist(), pdf.tokens.tolist()))
        n, gone = self.past.get() if self.past.exists() else (0, -(1 << 62))
        n += 1
        kept, gone = self.compacted(messages, gone)
        self.kept.put(kept) if kept else self.kept.clear()
        self.past.update((n, gone))
        told = [m[:3] for m in kept] or [(None, None, None)]  # an empty memory is news, too
        out = pd.DataFrame(told, columns=["turn", "role", "text"])
        yield pd.DataFrame({"conv_id": key[0], "version": n, "turn": out.turn.astype("Int64"), "role": out.role, "text": out.text})

    def compacted(self, messages: list[tuple], gone: int) -> tuple[list[tuple], int]:
        fixed = [m for m in messages if m[1] == "system"]
        others = sorted(m for m in messages if m[1] != "system" and m[0] > gone)
        total = sum(m[3] for m in fixed + others)
        while others and (total > self.max_tokens or len(others) > 2 * self.max_turns):
            gone = others[0][0]
            total -= others.pop(0)[3]
        return sorted(fixed) + others, gone

    def close(self) -> None:
        pass


def session_memory(messages: DataFrame, max_turns: int = 20, max_tokens: int = 4000) -> DataFrame:
    """A stream of messages (conv_id, turn, role, text) to (conv_id, version, turn, role, text): after every batch, the memory of the
    conversations that it touched; the largest version is the present one. A memory that lost all its messages has one row of nulls."""
    rows = messages.select("conv_id", F.col("turn").cast("long"), "role", "text", token_estimate(F.col("text")).cast("long").alias("tokens"))
    kind = messages.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, version long, turn long, role string, text string"
    return rows.groupBy("conv_id").transformWithStateInPandas(Memory(max_turns, max_tokens), StructType.fromDDL(schema), "Update", "None")


class Answers(StatefulProcessor):
    """The answer of a key, as long as its time to live runs; a request that finds none stores its own."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.answer = handle.getValueState("answer", "value string", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = self.answer.get()[0] if self.answer.exists() else None
        for pdf in rows:
            pdf = pdf.sort_values("request_id")
            hits, values = [], []
            for value in pdf["value"]:
                hits.append(held is not None)
                if held is None and value is not None:
                    held = value
                    self.answer.update((value,))
                values.append(held)
            yield pd.DataFrame({"request_id": pdf.request_id.to_numpy(), "hit": hits, "value": values})

    def close(self) -> None:
        pass


def answers_within(requests: DataFrame, ttl_ms: int) -> DataFrame:
    """A stream of requests (key, request_id, value: the answer if it has to be computed; null keys and nulls are never hits) to
    (request_id, hit, value): the value that is served. State that is older than the time to live is gone."""
    schema = f"request_id {requests.schema['request_id'].dataType.simpleString()}, hit boolean, value string"
    by = requests.select("key", "request_id", F.col("value").cast("string")).groupBy("key")
    return by.transformWithStateInPandas(Answers(ttl_ms), StructType.fromDDL(schema), "Update", "ProcessingTime")


def drained(stream: DataFrame, path: str | None = None, checkpoint: str | None = None, **trigger) -> DataFrame:
    """What a stream gives for all that is there now, as a table. A replayed batch overwrites its own files. State by processing time
    always has another batch to run: such a stream is drained with once=True."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/lodestream/{uuid.uuid4().hex}"
    path, checkpoint = path or f"{base}/rows", checkpoint or f"{base}/checkpoint"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
