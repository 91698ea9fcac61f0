"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_hash
from ..operators import metrics


def deduplicated(docs: DataFrame, event_time: str, delay: str = "1 hour", text: str = "text") -> DataFrame:
    """First-seen documents of a stream: state for a hash is kept for the watermark's delay."""
    return docs.withWatermark(event_time, delay).withColumn("content_hash", content_hash(F.col(text))).dropDuplicatesWithinWatermark(["content_hash"])


def running_counters(points: DataFrame, event_time: str = "ts", window: str = "1 minute", delay: str = "5 minutes") -> DataFrame:
    """Sums and counts per name and tumbling window; late rows beyond the delay are left out."""
    return points.withWatermark(event_time, delay).groupBy(F.window(event_time, window), "name").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


def sessions(events: DataFrame, key: str = "user_id", event_time: str = "ts", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark(event_time, delay).groupBy(F.session_window(event_time, gap), key).agg(F.count("*").alias("events"))


def feedback_rates(events: DataFrame, event_time: str = "ts", delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    return events.withWatermark(event_time, delay).groupBy(F.window(event_time, window), "chunk_id").agg(F.avg("score").alias("mean_score"), F.avg((F.col("score") >= 0.5).cast("double")).alias("positive_rate"))


def index_into(docs: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], **trigger) -> StreamingQuery:
    """An incremental index: every micro-batch is transformed (chunked, embedded) and appended once; the batch id makes a replay
    overwrite its own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def histogram_of_batch(batch: DataFrame) -> DataFrame:
    return metrics.histograms(batch)
