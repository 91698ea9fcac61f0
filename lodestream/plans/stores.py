"""Vector store mutations, sources, cache keys."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import store as S
from ..operators.metadata import FieldFilter, as_variant, passing
from ..operators.tables import shared_dir
from ..sources import loaders as L
from .registry import query, table


def _items(spark, d):
    e = table(spark, d, "embeddings")
    return S.with_namespace(e.select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").alias("label")), "main")


@query("store_upsert", "select vec_id as chunk_id, case when vec_id % 10 = 0 then -1 else label end as label from embeddings union all select vec_id + 1000000, -1 from embeddings where vec_id % 50 = 0")
def store_upsert(spark, d):
    s = _items(spark, d)
    new = s.where("chunk_id % 10 = 0").withColumn("label", F.lit(-1))
    more = s.where("chunk_id % 50 = 0").withColumn("chunk_id", F.col("chunk_id") + 1000000).withColumn("label", F.lit(-1))
    return S.upsert(s, new.union(more)).select("chunk_id", "label")


@query("store_delete", "select vec_id as chunk_id from embeddings where label <> 3")
def store_delete(spark, d):
    s = _items(spark, d)
    return S.delete(s, s.where("label = 3").select("chunk_id"), "main")[0].select("chunk_id")


@query("store_add", "select vec_id as chunk_id from embeddings union all select -1 - vec_id from embeddings where label = 1")
def store_add(spark, d):
    s = _items(spark, d)
    return S.add(s, S.checked(s.where("label = 1").withColumn("chunk_id", -1 - F.col("chunk_id")), 64)).select("chunk_id")


@query("store_namespaces", "select 'ns' || (label % 2) as namespace, count(*) as n from embeddings where label % 2 = 1 group by 1")
def store_namespaces(spark, d):
    s = _items(spark, d).withColumn("namespace", F.concat(F.lit("ns"), (F.col("label") % 2).cast("string")))
    return S.cleared(s, "ns0").groupBy("namespace").agg(F.count("*").alias("n"))


@query("source_rows", "select sha256('customer#row' || c_custkey) as doc_id, 'c_custkey: ' || c_custkey || ' | c_name: ' || c_name || ' | c_mktsegment: ' || c_mktsegment as text, c_name as title from customer")
def source_rows(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return L.documents_from_rows(c, "c_custkey", title="c_name", source="customer").select("doc_id", "text", "title")


@query("source_json_props", "select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def source_json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("source_html_pages")
def source_html_pages(spark, d):
    return L.parse_html(table(spark, d, "pages"), "page_id")


@query("cache_keys", r"select item_id, md5(trim(regexp_replace(lower(text), '[\s\p{Z}]+', ' ', 'g')) || '|k=10|f=') as cache_key from benchmark")
def cache_keys(spark, d):
    from ..operators.cache import result_key

    return table(spark, d, "benchmark").select("item_id", result_key(F.col("text")).alias("cache_key"))


@query("store_get", "select vec_id as chunk_id, label from embeddings where vec_id % 7 = 0 and label % 2 = 1")
def store_get(spark, d):
    s = _items(spark, d).withColumn("namespace", F.concat(F.lit("ns"), (F.col("label") % 2).cast("string")))
    ids = s.where("chunk_id % 7 = 0").select("chunk_id").union(s.select((-1 - F.col("chunk_id")).alias("chunk_id")))
    return S.get(s, ids, "ns1").select("chunk_id", "label")


@query("store_list_ids", "select vec_id as chunk_id from embeddings where label % 2 = 0")
def store_list_ids(spark, d):
    s = _items(spark, d).withColumn("namespace", F.concat(F.lit("ns"), (F.col("label") % 2).cast("string")))
    return S.list_ids(s, "ns0")


def _new_path(spark, kind):
    return f"{shared_dir(spark)}/lodestream/{kind}-{uuid.uuid4().hex}"


@query("store_persisted", "select vec_id as chunk_id, 'ns' || (label % 2) as namespace, len(embedding)::int as dimensions, label from embeddings")
def store_persisted(spark, d):
    """Written by namespace and read again."""
    s = _items(spark, d).withColumn("namespace", F.concat(F.lit("ns"), (F.col("label") % 2).cast("string")))
    path = _new_path(spark, "store")
    S.persist(s, path)
    return S.load(spark, path).select("chunk_id", "namespace", F.size("embedding").alias("dimensions"), "label")


@query("metadata_filtered", """
with k as (select event_id, event_type, (props->>'k')::bigint as k from events)
select event_id, k from k where k > 40 and k not in (50, 60) and k <> 45 and event_type <> 'view'""")
def metadata_filtered(spark, d):
    """Events by what their free-form properties hold."""
    e = table(spark, d, "events").select("event_id", "event_type", "props")
    keep = [FieldFilter("k", "gt", 40), FieldFilter("k", "not_in", [50, 60]), FieldFilter("k", "neq", 45)]
    return passing(as_variant(e.where("event_type <> 'view'"), "props"), keep).select("event_id", F.expr("variant_get(metadata, '$.k', 'bigint')").alias("k"))


@query("source_csv", "select 'c_custkey: ' || c_custkey || ' | c_name: ' || c_name || ' | c_mktsegment: ' || c_mktsegment as text, c_name as title, 'csv' as format from customer")
def source_csv(spark, d):
    """Customers as CSV files with a header, loaded as documents."""
    path = _new_path(spark, "csv")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("header", "true").csv(path)
    return L.load_csv(spark, path, title="c_name").select("text", "title", "format")


@query("source_json", "select text, source as title, lang, 'json' as format from documents where text is not null")
def source_json(spark, d):
    """Documents as JSON lines, loaded by key."""
    path = _new_path(spark, "docs") + ".jsonl"
    table(spark, d, "documents").where("text is not null").select("text", "source", "lang").write.json(path)
    got = L.load_json(spark, path, content_key="text", title_key="source", metadata_keys=("lang",))
    return got.select("text", "title", F.try_element_at("extra", F.lit("lang")).alias("lang"), "format")


@query("source_markdown", "select item_id::varchar as title, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text, 'markdown' as format from benchmark")
def source_markdown(spark, d):
    """Benchmark items as Markdown files with front matter, a file a row, loaded from the files."""
    head = F.concat(F.lit("---\ntitle: "), F.col("item_id").cast("string"), F.lit("\n---\n"))
    path = _files(table(spark, d, "benchmark"), F.concat(head, F.trim(F.regexp_replace("text", r"\s+", " "))))
    return L.load_markdown(spark, path, glob="part-*").select("title", "text", "format")


@query("source_markdown_sections", r"""
with t as (select item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from benchmark)
select h as title, '# ' || h || chr(10) || t as text from (select 'First ' || item_id as h, t from t union all select 'Second ' || item_id, t from t)""")
def source_markdown_sections(spark, d):
    """Each text under two headings of a Markdown file, and a heading with too little below it; loaded by section."""
    t, i = F.trim(F.regexp_replace("text", r"\s+", " ")), F.col("item_id").cast("string")
    body = F.concat(F.lit("before\n# First "), i, F.lit("\n"), t, F.lit("\n\n## x\n\n# Second "), i, F.lit("\n"), t)
    path = _files(table(spark, d, "benchmark"), body)
    return L.load_markdown(spark, path, sections=True, min_chars=20, glob="part-*").select("title", "text")


@query("source_text", "select text || chr(10) as text, 'text' as format from benchmark")
def source_text(spark, d):
    """Benchmark items as text files, a file a row."""
    return L.load_text(spark, _files(table(spark, d, "benchmark"), F.col("text")), glob="part-*").select("text", "format")


def _files(rows, text):
    """A text file, in a folder of its own, for each row."""
    path = _new_path(rows.sparkSession, "files")
    rows.select(text.alias("value"), "item_id").write.partitionBy("item_id").text(path)
    return path
