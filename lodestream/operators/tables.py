"""Where tables of our own go, and how small inputs are spread over the cores."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession

CORE_BYTES = 128 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. On one machine without it, a temporary folder; else it has to be set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        at = tempfile.mkdtemp(prefix="lodestream-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def table_of(df: DataFrame) -> DataFrame:
    """df, written down in the shared folder: what several steps read, or what ends a round."""
    path = f"{shared_dir(df.sparkSession)}/lodestream/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores, if they come from fewer files than cores and are less than CORE_BYTES a core; else df itself.
    Rows of one Parquet row group are one task's work however large the cluster is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > CORE_BYTES * cores or not 0 < len(df.inputFiles()) < cores:
        return df
    parts = min(cores, math.ceil(size / (1 << 17)))
    return df.repartition(parts) if parts > 1 else df
