"""Table functions for SQL.

    register(spark)
    SELECT * FROM chunk_table(TABLE(SELECT doc_id, text FROM documents), size => 512, overlap => 50)
    SELECT d.doc_id, c.* FROM documents d, LATERAL chunk_text(d.text, 512, 50) c

`chunk_table` takes a table of any columns and hands all but the text on; with PARTITION BY a document's rows stay in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .chunking import checked, merge_pieces, split_recursive

PIECE = [StructField("index", IntegerType()), StructField("start_char", IntegerType()), StructField("end_char", IntegerType()), StructField("content", StringType())]


def pieces(text: str | None, size: int, overlap: int) -> Iterator[tuple[int, int, int, str]]:
    """The recursive chunks of one text with their places."""
    text, off = text or "", 0
    for i, c in enumerate(merge_pieces(split_recursive(text, size), size, overlap)):
        k = text.find(c, off)
        start = k if k >= 0 else off
        off = max(off, start + 1)
        yield i, start, start + len(c), c


class ChunkTable:
    @staticmethod
    def analyze(rows: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None, text: AnalyzeArgument | None = None) -> AnalyzeResult:
        column = text.value if text is not None else "text"
        if not rows.isTable or column not in rows.dataType.fieldNames():
            raise ValueError(f"chunk_table takes a table with a column {column}")
        checked(size.value if size is not None else 512, overlap.value if overlap is not None else 50)
        return AnalyzeResult(StructType([f for f in rows.dataType.fields if f.name != column] + PIECE))

    def eval(self, rows: Row, size: int = 512, overlap: int = 50, text: str = "text") -> Iterator[tuple]:
        others = [rows[c] for c in rows.__fields__ if c != text]
        for piece in pieces(rows[text], size, overlap):
            yield (*others, *piece)


class ChunkText:
    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        checked(size, overlap)
        yield from pieces(text, size, overlap)


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk_table", udtf(ChunkTable))
    spark.udtf.register("chunk_text", udtf(ChunkText, returnType=StructType(PIECE)))
