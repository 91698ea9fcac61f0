"""python -m lodestream.cli index|search|ask|eval|info ...: the engine from a shell."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from .operators import evaluation, store
from .plans.pipeline import PRESETS, Pipeline, load_config, session
from .sources import loaders


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestream")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"index": ("source", "index"), "search": ("index", "query"), "ask": ("index", "query"), "eval": ("samples",), "info": ()}.items():
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        c.add_argument("--config")
        c.add_argument("--top-k", type=int, default=None)
    a = p.parse_args(argv)
    if a.command == "info":
        print(json.dumps({"presets": sorted(PRESETS), "formats": sorted(set(loaders.FORMATS.values())), "metrics": evaluation.METRICS}))
        return 0
    spark = session()
    pipe = Pipeline(load_config(a.config) if a.config else PRESETS["rag"])
    if a.command == "index":
        docs = loaders.load(spark, a.source) if loaders.format_of(a.source) else loaders.load_text(spark, a.source)
        pipe.ingest(docs)
        store.persist(pipe.index, a.index)
        print(json.dumps(pipe.stats()))
    elif a.command in ("search", "ask"):
        pipe.index = store.load(spark, a.index)
        q = spark.createDataFrame([("1", a.query)], "query_id string, query string")
        rows = pipe.retrieve(q, a.top_k).orderBy("rank") if a.command == "search" else pipe.query(q, a.top_k).select("answer", "sources")
        for r in rows.toJSON().collect():  # at most top-k
            print(r)
    else:
        samples = spark.read.option("mode", "DROPMALFORMED").json(a.samples)
        for c, kind in (("reference", "string"), ("sample_id", "string")):
            if c not in samples.columns:
                samples = samples.withColumn(c, F.lit(None).cast(kind) if c == "reference" else F.monotonically_increasing_id().cast("string"))
        for r in evaluation.answer_report(evaluation.answer_metrics(samples)).orderBy("metric").toJSON().collect():
            print(r)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
