"""Queries over texts: projections, hashes, duplicates, chunkers, compression, graph extraction."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import context as X
from ..operators import dedup as D
from ..operators import diversity as V
from ..operators import graph as G
from ..operators.embedding import hash_vector
from ..operators.greedy import greedy_minhash, greedy_simhash
from ..operators.graph_index import GraphIndex
from ..operators.table_functions import register
from ..operators.tables import shared_dir
from .registry import query, table
from .retrieval import asked, chunks, index

class _Sql(str):
    """SQL with {0} for a column; other braces stand for themselves."""

    def format(self, column: str) -> str:
        return self.replace("{0}", column)


_WORDS = _Sql(r"list_filter(regexp_split_to_array({0}, '[\s\p{Z}]+'), lambda t: t <> '')")
_SPACED = _Sql(r"trim(regexp_replace({0}, '[\s\p{Z}]+', ' ', 'g'))")
_LOOSE = _Sql(_SPACED.format(r"regexp_replace(lower({0}), '[^\p{L}\p{N}_\s\p{Z}]', '', 'g')"))

@query("document_profile", f"""
select doc_id, sha256(text) as content_sha256, length(text)::int as char_count, len({_WORDS.format('text')})::int as word_count, greatest(1, length(text) // 4)::bigint as token_estimate from documents""")
def document_profile(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.sha2(t, 256).alias("content_sha256"), F.length(t).alias("char_count"), F.size(T.split_words(t)).alias("word_count"), T.token_estimate(t).alias("token_estimate"))


_HASHED = f"select *, sha256(lower({_SPACED.format('text')})) as content_hash from documents"


@query("dedup_first_seen", f"select min(doc_id) as doc_id, content_hash from ({_HASHED}) group by content_hash")
def dedup_first_seen(spark, d):
    return D.first_seen(table(spark, d, "documents")).select("doc_id", "content_hash")


_SEEN = f"with h as (select content_hash, count(*) as c from ({_HASHED}) group by 1) select sum(c)::bigint as total_seen, sum(c - 1)::bigint as duplicates_skipped, count(*) as unique_loaded from h"


@query("dedup_stats", _SEEN)
def dedup_stats(spark, d):
    return D.registry_stats(table(spark, d, "documents"))


@query("dedup_observed", _SEEN)
def dedup_observed(spark, d):
    """The statistics, observed in the job that writes the first documents."""
    path = f"{shared_dir(spark)}/lodestream/{uuid.uuid4().hex}"
    return spark.createDataFrame([D.write_first_seen(table(spark, d, "documents"), path)], "total_seen long, duplicates_skipped long, unique_loaded long")


@query("dedup_is_duplicate", f"select doc_id from ({_HASHED}) where content_hash in (select content_hash from ({_HASHED}) where source = 'src0')")
def dedup_is_duplicate(spark, d):
    docs = table(spark, d, "documents")
    registry = docs.where("source = 'src0'").select(T.content_hash(F.col("text")).alias("content_hash"))
    return D.is_duplicate(docs, registry).select("doc_id")


@query("dedup_exact_by_source", f"""
with r as (select source, doc_id, text, doc_id as rank from documents)
select source as query_id, doc_id as chunk_id, rank, min(rank) over (partition by source, md5({_LOOSE.format('text')})) as canonical_rank from r""")
def dedup_exact_by_source(spark, d):
    docs = table(spark, d, "documents")  # a source is one long list, ranked by id
    ranked = docs.select(F.col("source").alias("query_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("doc_id").alias("rank"))
    return D.exact_groups(ranked).select("query_id", "chunk_id", "rank", "canonical_rank")


_GRAMS = f"""
with recursive t as (select item_id, {_LOOSE.format('text')} as t from benchmark),
g as (select item_id, case when length(t) < 3 then [t] else list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) end as grams from t where t <> '')
"""


_SIMHASH = _GRAMS + """, m as (select item_id, md5(unnest(grams)) as m from g),
h as (select item_id, ('0x' || substr(m, 17, 8))::bigint as hi, ('0x' || substr(m, 25, 8))::bigint as lo from m),
v as (select item_id, b, sum(case when (hi >> b::bigint) & 1 = 1 then 1 else -1 end) as vh, sum(case when (lo >> b::bigint) & 1 = 1 then 1 else -1 end) as vl from h, range(0, 32) r(b) group by item_id, b),
fp as (select item_id, sum(case when vh > 0 then 1::bigint << b else 0 end)::bigint as hi, sum(case when vl > 0 then 1::bigint << b else 0 end)::bigint as lo from v group by item_id)
"""


def _sequential(rows: str, kind: str, near: str) -> str:
    """The greedy rule row by row: each is held against the list of those that stay."""
    return f"""
o as materialized (select doc_id, x, row_number() over (order by doc_id) as rn from {rows}),
s as (select 0::bigint as rn, null::bigint as doc_id, null::bigint as home, []::struct(d bigint, x {kind})[] as kept
 union all select rn, doc_id, home, case when home is null then list_append(kept, {{'d': doc_id, 'x': x}}) else kept end
 from (select o.*, kept, list_filter(kept, lambda k: {near})[1].d as home from s join o on o.rn = s.rn + 1))
select doc_id, coalesce(home, doc_id) as kept_as from s where rn > 0"""


@query("simhash", _SIMHASH + "select * from fp")
def simhash(spark, d):
    return D.simhash_rows(table(spark, d, "benchmark"), key="item_id")


@query("dedup_simhash_corpus", _SIMHASH.replace("item_id", "doc_id").replace("benchmark", "documents") + ", z as (select d.doc_id, [coalesce(hi, 0), coalesce(lo, 0)] as x from documents d left join fp using (doc_id)), "
       + _sequential("z", "bigint[]", "bit_count(xor(k.x[1], x[1])) + bit_count(xor(k.x[2], x[2])) <= 3"))
def dedup_simhash_corpus(spark, d):
    """Every document, in order, against those before it that stay."""
    return greedy_simhash(D.simhash_rows(table(spark, d, "documents")))


_MINHASH = _GRAMS + """, sig as (select item_id, list_transform(range(0, 128), lambda i:
 list_min(list_transform(grams, lambda z: ('0x' || substr(md5(unhex(lpad(printf('%x', i), 2, '0') || '000000') || encode(z)), 1, 8))::bigint))) as x from g),
z as (select d.item_id as doc_id, coalesce(x, list_transform(range(0, 128), lambda i: 4294967295::bigint)) as x from benchmark d left join sig using (item_id)), """


@query("dedup_minhash_corpus", _MINHASH + _sequential("z", "bigint[]", "len(list_filter(range(1, 129), lambda i: k.x[i] = x[i])) / 128.0 >= 0.8"))
def dedup_minhash_corpus(spark, d):
    """Every benchmark item, in order, against those before it that stay."""
    return greedy_minhash(D.minhash_rows(table(spark, d, "benchmark"), key="item_id").withColumnRenamed("item_id", "doc_id"))


@query("minhash", _GRAMS + """
select item_id, i::int as i, list_min(list_transform(grams, lambda z: ('0x' || substr(md5(unhex(lpad(printf('%x', i), 2, '0') || '000000') || encode(z)), 1, 8))::bigint)) as x from g, range(0, 128) r(i)""")
def minhash(spark, d):
    q = table(spark, d, "benchmark").where(T.loose(F.col("text")) != "")
    return D.minhash_rows(q, key="item_id").select("item_id", F.posexplode("signature").alias("i", "x"))


def _ranked(spark, d, k=10):
    c, q = chunks(spark, d), asked(spark, d)
    return index(spark, d).top_k(q, k).join(c.select("chunk_id", "content"), "chunk_id").join(q, "query_id")


@query("dedup_simhash_results")
def dedup_simhash_results(spark, d):
    r = _ranked(spark, d)
    h = D.simhash_rows(r.select("chunk_id", "content").distinct(), "content", "chunk_id")
    return D.greedy_by_hamming(r.join(h, "chunk_id"))


@query("dedup_minhash_results")
def dedup_minhash_results(spark, d):
    r = _ranked(spark, d, 5)
    s = D.minhash_rows(r.select("chunk_id", "content").distinct(), "content", "chunk_id")
    return D.greedy_by_minhash(r.join(s, "chunk_id"))


def _with_vectors(spark, d):
    v = F.col("content")
    return _ranked(spark, d).withColumn("embedding", hash_vector(v, 16)).withColumn("vector", hash_vector(F.col("query"), 16))


@query("mmr_select")
def mmr_select(spark, d):
    return V.mmr(_with_vectors(spark, d), 5).withColumn("score", F.round("score", 6))


@query("greedy_diversify")
def greedy_diversify(spark, d):
    return V.greedy_diverse(_with_vectors(spark, d), 0.3)


@query("chunk_fixed", r"""
with s as (select doc_id, text, unnest(range(0, length(text), 200)) as p from documents where length(text) > 0),
k as (select doc_id, p::int as start_char, least(p + 256, length(text))::int as end_char, substr(text, p + 1, 256) as content from s where not regexp_full_match(substr(text, p + 1, 256), '[\s\p{Z}]*'))
select doc_id || '#' || (row_number() over (partition by doc_id order by start_char) - 1) as chunk_id, doc_id as document_id, (row_number() over (partition by doc_id order by start_char) - 1)::int as index, start_char, end_char, content from k""")
def chunk_fixed(spark, d):
    return C.fixed_chunks(table(spark, d, "documents"), 256, 56)


@query("chunk_recursive")
def chunk_recursive(spark, d):
    return C.recursive_chunks(table(spark, d, "documents"))


@query("chunk_table_function")
def chunk_table_function(spark, d):
    """The recursive chunks through SQL's table function."""
    register(spark)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    rows = spark.sql("select * from chunk_table(table(select * from {docs}), size => 512, overlap => 50)", docs=docs)
    return rows.select(F.concat_ws("#", F.col("document_id").cast("string"), F.col("index").cast("string")).alias("chunk_id"), *rows.columns)


@query("chunk_sentence")
def chunk_sentence(spark, d):
    return C.sentence_chunks(table(spark, d, "documents"))


@query("chunk_semantic")
def chunk_semantic(spark, d):
    return C.semantic_chunks(table(spark, d, "documents"))


@query("sentences", r"""
with s as (select item_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[\s\p{Z}]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '' and length(x) >= 5) as s from benchmark)
select item_id, i::int as i, s[i] as sentence from s, range(1, 1000) r(i) where i <= len(s)""")
def sentences(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.posexplode(T.sentences(F.col("text"), 5)).alias("i", "sentence")).withColumn("i", F.col("i") + 1)


@query("word_shingle_jaccard", f"""
with w as (select item_id, {_WORDS.format('text')} as w from benchmark),
g as (select item_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from w where len(w) >= 2)
select a.item_id, round(len(list_intersect(a.g, b.g))::double / len(list_distinct(list_concat(a.g, b.g))), 6) as jaccard from g a join g b on b.item_id = a.item_id + 1""")
def word_shingle_jaccard(spark, d):
    g = table(spark, d, "benchmark").where(F.size(T.split_words(F.col("text"))) >= 2).select("item_id", T.word_shingles(F.col("text")).alias("g"))
    p = g.join(g.select((F.col("item_id") - 1).alias("item_id"), F.col("g").alias("h")), "item_id")
    return p.select("item_id", F.round(T.jaccard(F.col("g"), F.col("h")), 6).alias("jaccard"))


@query("compress_sentences")
def compress_sentences(spark, d):
    return X.sentence_compressed(_ranked(spark, d, 5)).select("query_id", "chunk_id", "compressed", F.round("ratio", 6).alias("ratio"), F.round("relevance", 6).alias("relevance"))


@query("compress_keywords")
def compress_keywords(spark, d):
    return X.keyword_compressed(_ranked(spark, d, 5)).select("query_id", "chunk_id", "compressed", F.round("ratio", 6).alias("ratio"), F.round("relevance", 6).alias("relevance"))


@query("explain_results")
def explain_results(spark, d):
    t = X.term_overlap(_ranked(spark, d, 5))
    return t.select("query_id", "chunk_id", "rank", "score", F.array_join("matched_terms", ",").alias("matched_terms"), F.round("overlap", 6).alias("overlap"), X.explanation().alias("summary"))


@query("adaptive_depth")
def adaptive_depth(spark, d):
    return X.adaptive(_ranked(spark, d, 20), asked(spark, d))


# the graph of nations and regions, where every entity is known
def _nations(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rel = n.select(F.col("n_name").alias("subject"), F.lit("PART_OF").alias("predicate"), F.col("r_name").alias("obj"), F.lit(1.0).alias("weight"), F.col("n_nationkey").alias("doc_id"))
    return G.relations(rel)


_EDGES = "select lower(n_name) as u, lower(r_name) as v from nation join region on n_regionkey = r_regionkey"


@query("graph_neighbours", f"""
with recursive e as ({_EDGES}), b as (select u, v from e union select v, u from e),
w as (select lower(n_name) as start, lower(n_name) as node, 0 as hops from nation union all select w.start, b.v, w.hops + 1 from w join b on b.u = w.node where w.hops < 2)
select start, node, min(hops)::int as hops from w where node <> start group by start, node""")
def graph_neighbours(spark, d):
    return G.neighbours(_nations(spark, d), table(spark, d, "nation").select(F.col("n_name").alias("start")), 2)


@query("graph_relations", "select n_name as subject, 'PART_OF' as predicate, r_name as obj, 1.0::double as weight, 1 as docs from nation join region on n_regionkey = r_regionkey")
def graph_relations(spark, d):
    return _nations(spark, d).select("subject", "predicate", "obj", "weight", F.size("doc_ids").alias("docs"))


@query("graph_subgraph", "select n_name as subject, r_name as obj from nation join region on n_regionkey = r_regionkey where r_regionkey <= 1 and n_nationkey % 2 = 0")
def graph_subgraph(spark, d):
    names = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name")).union(table(spark, d, "region").where("r_regionkey <= 1").select("r_name"))
    ent = names.select(F.lower("name").alias("key"))
    return G.subgraph(ent, _nations(spark, d), names)[1].select("subject", "obj")


_WORD = r"regexp_extract_all({0}, '[\p{L}\p{M}\p{N}\p{Pc}]+')"
_MEASURE = r"\d+(?:\.\d+)?\s*(?:dimensions?|layers?|heads?|tokens?|bytes?|ms|seconds?)"


_ENTITIES = rf"""
with w as (select doc_id, unnest({_WORD.replace('{0}', 'text')}) as name from documents),
t as (select doc_id, lower(name) as key, 0 as pass from w where lower(name) in ({','.join(f"'{x}'" for x in G.TERMS)})),
a as (select doc_id, lower(name) as key, 1 as pass from w where regexp_full_match(name, '[A-Z]{{2,8}}s?')),
m as (select doc_id, lower(unnest(regexp_extract_all(text, '(?i)\b({_MEASURE})\b', 1))) as key, 3 as pass from documents),
u as (select doc_id, key, min(pass) as pass from (select * from t union all select * from a union all select * from m) group by all)
select key, case arg_min(pass, doc_id) when 0 then 'TECHNOLOGY' when 1 then 'ACRONYM' else 'MEASURE' end as type, count(*)::int as docs from u group by key"""


@query("graph_entities", _ENTITIES)
def graph_entities(spark, d):
    return G.entities(G.mentions(table(spark, d, "documents"))).select("key", "type", F.size("doc_ids").alias("docs"))


@query("graph_incremental", _ENTITIES.replace("count(*)::int as docs", "count(*) as docs"))
def graph_incremental(spark, d):
    """The documents indexed by language, one batch after another; one of the batches twice, as after a failure."""
    g, docs = GraphIndex(spark, f"{shared_dir(spark)}/lodestream/graph-{uuid.uuid4().hex}"), table(spark, d, "documents")
    first = F.coalesce(F.col("lang").isin("en", "de"), F.lit(False))
    for batch, rows in ((0, docs.where(first)), (1, docs.where(~first)), (1, docs.where(~first))):
        g.index(rows, batch)
    return g.entities().select("key", "type", F.col("documents").alias("docs"))


@query("graph_alias_lookup", f"select 'That ' || key as asked, key, docs from ({_ENTITIES.replace('count(*)::int as docs', 'count(*) as docs')})")
def graph_alias_lookup(spark, d):
    """Every entity of the documents, looked up by an alias of its alias."""
    g = GraphIndex(spark, f"{shared_dir(spark)}/lodestream/graph-{uuid.uuid4().hex}")
    g.index(table(spark, d, "documents"), 0)
    key = g.entities().select("key")
    the = F.concat(F.lit("the "), "key")
    g.add_aliases(key.select(the.alias("alias"), F.col("key").alias("name")).union(key.select(F.concat(F.lit("that "), "key"), the)), 0)
    return g.lookup(key.select(F.concat(F.lit("That "), "key").alias("name"))).select("asked", "key", F.col("documents").alias("docs"))


# sentences that state where nations lie and what they trade, so that every pattern has something to find
STATED = ("{n} is a {r}", "{n} is part of {r}", "{n} uses {r}", "{n} extends {r}", "{n} is built on {r}", "{n} is developed by {r}", "{n} integrates with {r}", "{n} and {r} are related")


def _stated(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = lambda c: F.regexp_replace(c, r"\W", "")
    shape = F.element_at(F.array(*[F.lit(x) for x in STATED]), (F.col("n_nationkey") % len(STATED) + 1).cast("int"))
    text = F.replace(F.replace(shape, F.lit("{n}"), name("n_name")), F.lit("{r}"), name("r_name"))
    return n.select(F.col("n_nationkey").cast("long").alias("doc_id"), name("n_name").alias("n"), name("r_name").alias("r"), text.alias("text"))


@query("graph_stated_relations", r"""
with n as (select n_nationkey, lower(regexp_replace(n_name, '\W', '', 'g')) as n, lower(regexp_replace(r_name, '\W', '', 'g')) as r from nation join region on n_regionkey = r_regionkey),
s as (select n as subject, ['IS_A', 'PART_OF', 'USES', 'EXTENDS', 'BUILT_ON', 'DEVELOPED_BY', 'INTEGRATES_WITH', 'RELATED_TO'][n_nationkey % 8 + 1] as predicate, r as obj, 1.0::double as weight, 1 as docs from n)
select * from s union all select least(n, r), 'CO_OCCURS_WITH', greatest(n, r), 0.5::double, 1 from n""")
def graph_stated_relations(spark, d):
    docs = _stated(spark, d)
    found = docs.select("doc_id", F.explode(F.array(F.lower("n"), F.lower("r"))).alias("key"))
    return G.relations(G.stated_relations(docs.select("doc_id", "text"), found)).select("subject", "predicate", "obj", "weight", F.size("doc_ids").alias("docs"))


@query("graph_persisted", "select lower(n_name) as key, 'PART_OF' as predicate, r_name as obj from nation join region on n_regionkey = r_regionkey where lower(n_name) in ('nation_3', 'nation_4')")
def graph_persisted(spark, d):
    """Saved as JSON lines, loaded, and two entities looked up with their relations."""
    rel = _nations(spark, d)
    ent = rel.select(F.lower("subject").alias("key"), F.col("subject").alias("name"), F.lit("NATION").alias("type"), "doc_ids")
    path = f"{shared_dir(spark)}/lodestream/graph-{uuid.uuid4().hex}"
    G.save(ent, rel, path)
    ent, rel = G.load(spark, path)
    names = spark.createDataFrame([(" Nation_3",), ("NATION_4",), ("nowhere",)], "name string")
    return G.entity(ent, names).join(rel, F.col("name") == F.col("subject")).select("key", "predicate", "obj")


@query("graph_expanded_queries")
def graph_expanded_queries(spark, d):
    docs = table(spark, d, "documents")
    m = G.mentions(docs)
    rel = G.relations(G.stated_relations(docs, m))
    ent = G.entities(m)  # a query about each of them
    q = G.expanded_queries(ent.select(F.col("key").alias("query_id"), F.concat(F.lit("more about "), "name").alias("query")), ent, rel)
    return q.select("query_id", F.array_join("graph_entities", ",").alias("graph_entities"), "expanded")
