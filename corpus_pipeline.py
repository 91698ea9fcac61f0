"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, source mixing, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Rows with a null id
pass the stages that compare documents unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import checkpoint, table
from lodestream.llm.line_dedup import line_dedup
from lodestream.llm.mixing import mix_sources
from lodestream.llm.ngram_jaccard import ngram_jaccard_join
from lodestream.llm.quality_rules import kept_documents
from lodestream.llm.queries import PIECES
from lodestream.llm.sentencepiece_lattice import sentencepiece_encode


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return kept_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line matches; documents of which no word is left go. n_chars follows the text."""
    _, out = line_dedup(docs)
    out = out.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near duplicates."""
    members, _ = ngram_jaccard_join(docs)
    stay = members.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(stay, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in mixing order: files and their rows follow the schedule, and sources that run out come again."""
    place = "_place_" + "_".join(docs.columns)  # a name that no column has
    mixed = mix_sources(docs, into=(place, "_epoch" + place))
    return mixed.repartitionByRange(place).sortWithinPartitions(place).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip."""
    return sentencepiece_encode(docs, PIECES)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("mixing", mixing),
    ("sentencepiece", tokens),
]

# The stages iterate, parse and encode: their operators are held against brute force in tests/llm instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
