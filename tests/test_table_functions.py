import pytest
from lodestream.operators.chunking import recursive_chunks
from lodestream.operators.table_functions import register
from pyspark.errors import PySparkException


def test_rows_equal_the_data_frame_form(spark):
    register(spark)
    docs = spark.createDataFrame([(1, "en", "one two three. " * 40), (2, None, "short"), (3, "de", None), (4, "fr", "x" * 300)], "doc_id long, lang string, text string")
    docs.createOrReplaceTempView("docs_of_udtf")
    want = sorted((r.document_id, r["index"], r.start_char, r.end_char, r.content) for r in recursive_chunks(docs, 100, 20).collect())
    table = spark.sql("select * from chunk_table(table(select * from docs_of_udtf) partition by doc_id, size => 100, overlap => 20)")
    assert table.columns == ["doc_id", "lang", "index", "start_char", "end_char", "content"]
    assert sorted((r.doc_id, r["index"], r.start_char, r.end_char, r.content) for r in table.collect()) == want
    lateral = spark.sql("select d.doc_id, c.* from docs_of_udtf d, lateral chunk_text(d.text, 100, 20) c")
    assert sorted(tuple(r) for r in lateral.collect()) == want
    with pytest.raises(PySparkException):
        spark.sql("select * from chunk_table(table(select doc_id from docs_of_udtf))").collect()
