"""The deterministic hash embedder as a column expression, and batch embedding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import normalised


def hash_vector(text: Column, dimensions: int = 384) -> Column:
    """Component i is the first 32 bits of SHA-256(SHA-256(text) ‖ i), scaled to -1..1; the vector is then normalised."""
    seed = F.unhex(F.sha2(text, 256))
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(dimensions - 1)),
        lambda i: F.conv(F.substring(F.sha2(F.concat(seed, F.unhex(F.lpad(F.hex(i), 8, "0"))), 256), 1, 8), 16, 10).cast("double") / 4294967295.0 * 2.0 - 1.0,
    )
    return normalised(raw)


def embed(chunks: DataFrame, dimensions: int = 384, *, content: str = "content", model: Callable[[Column], Column] | None = None, name: str = "hash") -> DataFrame:
    """chunks with embedding, model and dimensions. `model` may be any column function, a pandas UDF among them."""
    vector = (model or (lambda c: hash_vector(c, dimensions)))(F.col(content))
    return chunks.withColumn("embedding", vector.cast("array<float>")).withColumn("model", F.lit(name)).withColumn("dimensions", F.size("embedding"))


def embed_distinct(chunks: DataFrame, model: Callable[[Column], Column], content: str = "content") -> DataFrame:
    """Every distinct text is embedded once and joined back: worth it for a costly model over many repeats."""
    once = chunks.select(content).distinct().withColumn("embedding", model(F.col(content)))
    return chunks.join(once, content)
