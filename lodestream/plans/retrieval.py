"""Retrieval queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions.text import BM25_STOP
from ..operators import bm25 as B
from ..operators import dense as D
from ..operators import evaluation as E
from ..operators import ranking as R
from ..operators.embedding import hash_vector
from ..operators.ivf import IVFIndex, recall
from ..operators.segments import SegmentedIndex
from ..operators.tables import spread
from .registry import query, table


def chunks(spark, d):
    return spread(table(spark, d, "documents")).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "lang", "source")


_BUILT: dict[tuple, B.Index] = {}


def index(spark, d) -> B.Index:
    """The text index of the documents: built once a session and table, as long as the table has the same files of the same age."""
    docs = table(spark, d, "documents")
    newest, n = docs.select("_metadata.file_modification_time").agg(F.max("file_modification_time"), F.count("*")).collect()[0]  # one row
    key = (spark.sparkContext.applicationId, d, newest, n, *sorted(docs.inputFiles()))
    if key not in _BUILT:
        _BUILT[key] = B.Index.build(chunks(spark, d))
    return _BUILT[key]


def asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_STOP = "(" + ",".join(f"'{w}'" for w in BM25_STOP) + ")"


def _tokens(col: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({col}), '[!-/:-@\\[-`{{-~]', ' ', 'g'), '[\\s\\p{{Z}}]+'), lambda t: t <> '' and t not in {_STOP})"


def _bm25(k1: float = 1.5, b: float = 0.75, k: int = 10, docs: str = "documents") -> str:
    return f"""
with tok as (select doc_id as chunk_id, {_tokens('text')} as tokens from {docs}),
st as (select count(*) as n, avg(len(tokens)) as avgdl from tok),
post as (select term, chunk_id, count(*) as tf, any_value(l) as l from (select chunk_id, len(tokens) as l, unnest(tokens) as term from tok) group by term, chunk_id),
idf as (select term, greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1), 0.25) as idf from post, st group by term, n),
q as (select query_id, term, count(*) as qtf from (select item_id as query_id, unnest({_tokens('text')}) as term from benchmark) group by all),
s as (select query_id, chunk_id, sum(qtf * idf * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * l / avgdl))) as score
 from q join post using (term) join idf using (term), st group by query_id, chunk_id having score > 0),
r as (select query_id, chunk_id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 6) desc, chunk_id) as rank from s)
select query_id, chunk_id, score, rank::int as rank from r where rank <= {k}"""


@query("bm25_topk", _bm25())
def bm25_topk(spark, d):
    return index(spark, d).top_k(asked(spark, d), 10)


@query("bm25_term_stats", f"""
with tok as (select {_tokens('text')} as tokens from documents)
select (select count(distinct t) from (select unnest(tokens) as t from tok)) as vocabulary_size, count(*) as corpus_size, round(avg(len(tokens)), 2) as avg_doc_length, sum(len(tokens))::bigint as total_tokens from tok""")
def bm25_term_stats(spark, d):
    return B.term_stats(index(spark, d))


@query("bm25_idf", f"""
with post as (select distinct doc_id, unnest({_tokens('text')}) as term from documents)
select term, count(*) as df, round(greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1), 0.25), 6) as idf from post, (select count(*) as n from documents) group by term, n""")
def bm25_idf(spark, d):
    return index(spark, d).idf(table(spark, d, "documents").count()).withColumn("idf", F.round("idf", 6))


@query("bm25_remove_chunks", f"""
with tok as (select {_tokens('text')} as tokens from documents where lang <> 'en')
select count(*) as n, round(avg(len(tokens)), 6) as avgdl, sum(len(tokens))::bigint as total_tokens from tok""")
def bm25_remove_chunks(spark, d):
    left = index(spark, d).without(chunks(spark, d).where("lang = 'en'"))
    return left.stats().withColumn("avgdl", F.round("avgdl", 6))


@query("bm25_pruned_topk", _bm25())
def bm25_pruned_topk(spark, d):
    """The rows of bm25_topk from the postings of the queries' terms."""
    index = SegmentedIndex.create(spark)
    index.add(chunks(spark, d))
    return index.top_k(asked(spark, d), 10)


@query("bm25_segments", _bm25(docs="(select * from documents where lang <> 'de' or lang is null)"))
def bm25_segments(spark, d):
    """One language after another added, one of them removed again."""
    index, c = SegmentedIndex.create(spark), chunks(spark, d)
    index.add(c.where("lang in ('en', 'de')"))
    index.add(c)
    index.remove(c.where("lang = 'de'"))
    return index.top_k(asked(spark, d), 10)


# dense search: the stated queries are the vectors whose id is divisible by 100
_DOT = "list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i] * b[i]))"
_VEC = "select vec_id, embedding::double[] as v, label from embeddings"


def _scored(expr: str, where: str = "true") -> str:
    return f"""
with v as ({_VEC}), p as (select q.vec_id as query_id, x.vec_id as chunk_id, q.v as a, x.v as b, x.label as label from v q, v x where q.vec_id % 100 = 0 and {where}),
s as (select query_id, chunk_id, round({expr}, 6) as score from p),
r as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s)
select query_id, chunk_id, score, rank::int as rank from r where rank <= 10"""


_COS = f"case when sqrt(list_sum(list_transform(a, lambda x: x * x))) * sqrt(list_sum(list_transform(b, lambda x: x * x))) = 0 then 0 else {_DOT} / (sqrt(list_sum(list_transform(a, lambda x: x * x))) * sqrt(list_sum(list_transform(b, lambda x: x * x)))) end"
_DIST = "sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i] - b[i]) * (a[i] - b[i]))))"


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def vector_queries(spark, d):
    return vectors(spark, d).where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))


@query("dense_topk_cosine", _scored(_COS))
def dense_topk_cosine(spark, d):
    return D.dense_top_k(vectors(spark, d), vector_queries(spark, d))


@query("dense_topk_dot", _scored(_DOT))
def dense_topk_dot(spark, d):
    return D.dense_top_k(vectors(spark, d), vector_queries(spark, d), metric="dot")


@query("dense_topk_euclidean", _scored(f"1 / (1 + {_DIST})"))
def dense_topk_euclidean(spark, d):
    return D.dense_top_k(vectors(spark, d), vector_queries(spark, d), metric="euclidean")


@query("dense_topk_filtered", _scored(_COS, "x.label > 2 and x.label in (1, 3, 5, 7) and x.label <> 5"))
def dense_topk_filtered(spark, d):
    f = [D.MetadataFilter("label", "gt", 2), D.MetadataFilter("label", "in", [1, 3, 5, 7]), D.MetadataFilter("label", "neq", 5)]
    return D.dense_top_k(vectors(spark, d), vector_queries(spark, d), filters=f)


@query("dense_topk_threshold", f"select * from ({_scored(_COS)}) where score >= 0.3")
def dense_topk_threshold(spark, d):
    return D.dense_top_k(vectors(spark, d), vector_queries(spark, d), threshold=0.3)


def _cells(spark, d):
    v = vectors(spark, d)
    return IVFIndex.build(v, cells=16, nprobe=2)


@query("dense_topk_all_cells", _scored(_COS))
def dense_topk_all_cells(spark, d):
    """The cells' index where every cell is looked into."""
    return _cells(spark, d).top_k(vector_queries(spark, d), nprobe=16)


@query("dense_cells_recall")
def dense_cells_recall(spark, d):
    """What the cells' index finds of the exact results, with nprobe tuned to 0.9."""
    q = vector_queries(spark, d)
    return recall(_cells(spark, d).tuned(q).top_k(q), dense_topk_cosine(spark, d))


@query("dense_min_max", f"""
with t as ({_scored(_COS)}), m as (select *, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from t)
select query_id, chunk_id, round(case when hi = lo then 1.0 else (score - lo) / (hi - lo) end, 6) as score, rank from m""")
def dense_min_max(spark, d):
    return R.min_max(dense_topk_cosine(spark, d)).withColumn("score", F.round("score", 6))


@query("vector_metrics", f"""
with p as (select x.vec_id, x.embedding::double[] as a, y.embedding::double[] as b from embeddings x join embeddings y on y.vec_id = x.vec_id + 1)
select vec_id, round({_COS}, 6) as cosine, round({_DIST}, 6) as euclidean, round({_DOT}, 6) as dot, round(sqrt(list_sum(list_transform(a, lambda x: x * x))), 6) as norm from p""")
def vector_metrics(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    a, b = F.col("a"), F.col("b")
    return p.select("vec_id", F.round(V.cosine(a, b), 6).alias("cosine"), F.round(V.euclidean(a, b), 6).alias("euclidean"), F.round(V.dot(a, b), 6).alias("dot"), F.round(V.norm(a), 6).alias("norm"))


@query("embed_hash", """
with h as (select item_id, unhex(sha256(text)) as h from benchmark),
e as (select item_id, list_transform(range(0, 16), lambda i: ('0x' || substr(sha256(h || unhex(lpad(printf('%x', i), 8, '0'))), 1, 8))::bigint / 4294967295.0::double * 2.0::double - 1.0::double) as v from h)
select item_id, i::int as i, round(v[i + 1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) as x from e, range(0, 16) t(i)""")
def embed_hash(spark, d):
    q = table(spark, d, "benchmark")
    return q.select("item_id", F.posexplode(hash_vector(F.col("text"), 16)).alias("i", "x")).withColumn("x", F.round("x", 6))


# fusion of two sparse lists of different length normalisation
def _lists(spark, d):
    i, q = index(spark, d), asked(spark, d)
    return [i.top_k(q, 30), i.top_k(q, 30, k1=1.2, b=0.2)]


_TWO = f"a as ({_bm25(k=30)}), b as ({_bm25(1.2, 0.2, 30)}), l as (select *, 0 as list from a union all select *, 1 as list from b)"


def _fused(part: str) -> str:
    return f"""
with {_TWO}, p as (select query_id, chunk_id, list, {part} as part from l),
s as (select query_id, chunk_id, round(sum(part), 6) as score, list_sort(list(distinct list))::varchar as lists from p group by query_id, chunk_id),
r as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s)
select query_id, chunk_id, score, lists, rank::int as rank from r where rank <= 10"""


def _top(fused):
    return R.top_k(fused.withColumn("lists", F.col("lists").cast("string")), 10)


@query("fusion_rrf", _fused("1 / (60.0 + rank)::double"))
def fusion_rrf(spark, d):
    return _top(R.rrf(_lists(spark, d)))


_W = "case list when 0 then 0.7::double else 0.3::double end"


@query("fusion_linear", _fused(f"case when max(score) over w = min(score) over w then 0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end * {_W}").replace("as part from l)", "as part from l window w as (partition by query_id, list))"))
def fusion_linear(spark, d):
    return _top(R.linear_fusion(_lists(spark, d), [0.7, 0.3]))


@query("fusion_dbsf", _fused(f"1 / (1 + exp(-(score - avg(score) over w) / case when stddev_pop(score) over w = 0 then 1 else stddev_pop(score) over w end)) * {_W}").replace("as part from l)", "as part from l window w as (partition by query_id, list))"))
def fusion_dbsf(spark, d):
    return _top(R.dbsf(_lists(spark, d), [0.7, 0.3]))


@query("hybrid_retrieve")
def hybrid_retrieve(spark, d):
    """Sparse and dense (hash vectors of 32 dimensions), each three times as deep, fused by reciprocal rank."""
    c, q = chunks(spark, d), asked(spark, d)
    dense = D.dense_top_k(c.withColumn("embedding", hash_vector(F.col("content"), 32)), q.withColumn("vector", hash_vector(F.col("query"), 32)), 30)
    return _top(R.rrf([index(spark, d).top_k(q, 30), dense]))


@query("rerank_linear", f"""
with t as ({_bm25(k=30)}), j as (select t.*, lower(b.text) as q, lower(x.text) as c, x.text as raw from t join benchmark b on b.item_id = query_id join documents x on x.doc_id = chunk_id),
k as (select *, list_distinct(list_filter(regexp_split_to_array(q, '[\\s\\p{{Z}}]+'), lambda z: z <> '')) as terms, len(list_filter(regexp_split_to_array(raw, '[\\s\\p{{Z}}]+'), lambda z: z <> '')) as n from j),
s as (select query_id, chunk_id, rank as original_rank, round(0.6::double * score + 0.3::double * case when len(terms) = 0 then 0 else len(list_filter(terms, lambda z: contains(c, z)))::double / len(terms) end
 + 0.1::double * case when contains(c, q) then 1 else 0 end + 0.05::double * greatest(0, 1 - 0.001::double * greatest(0, n - 200)), 6) as score from k),
r as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s)
select query_id, chunk_id, score, original_rank, rank::int as rank from r where rank <= 10""")
def rerank_linear(spark, d):
    c, q = chunks(spark, d), asked(spark, d)
    hits = index(spark, d).top_k(q, 30).join(q, "query_id").join(c.select("chunk_id", "content"), "chunk_id")
    return R.linear_rerank(hits, 10).select("query_id", "chunk_id", "score", "original_rank", "rank")


# a run of neighbours against the neighbours' labels as relevance
def _run(spark, d):
    run = dense_topk_cosine(spark, d)
    label = table(spark, d, "embeddings").select("vec_id", "label")
    q = label.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    qrels = q.join(label, "label").select("query_id", F.col("vec_id").alias("doc_id"), F.lit(1.0).alias("relevance"))
    return run.select("query_id", F.col("chunk_id").alias("doc_id"), "rank"), qrels


_IR = f"""
with run as ({_scored(_COS)}), qrels as (select q.vec_id as query_id, x.vec_id as doc_id from embeddings q join embeddings x using (label) where q.vec_id % 100 = 0),
h as (select r.query_id, r.rank, case when q.doc_id is null then 0 else 1 end as hit from run r left join qrels q on q.query_id = r.query_id and q.doc_id = r.chunk_id),
c as (select *, sum(hit) over (partition by query_id order by rank) / rank as prec from h),
n as (select query_id, count(*) as n_rel from qrels group by 1),
p as (select query_id, sum(hit) / any_value(n_rel)::double as recall, sum(hit)::double / count(*) as precision, sum(hit * prec)::double / any_value(n_rel) as ap,
 sum(hit / log2(rank + 1)) / (select sum(1 / log2(i + 1)) from range(1, 11) t(i) where i <= least(10, any_value(n_rel))) as ndcg, coalesce(1.0::double / min(case when hit = 1 then rank end), 0) as rr from c join n using (query_id) group by query_id)
"""


@query("ir_per_query", _IR + "select query_id, round(recall, 6) as recall, round(precision, 6) as precision, round(ap, 6) as ap, round(ndcg, 6) as ndcg, round(rr, 6) as rr from p")
def ir_per_query(spark, d):
    t = E.ir_per_query(*_run(spark, d))
    return t.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "ap", "ndcg", "rr")])


@query("ir_report", _IR + "select round(avg(recall), 6) as mean_recall, round(avg(precision), 6) as mean_precision, round(avg(ap), 6) as map, round(avg(ndcg), 6) as mean_ndcg, round(avg(rr), 6) as mrr, count(*) as n_queries from p")
def ir_report(spark, d):
    return E.ir_report(*_run(spark, d))
