"""The registered queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import cross_tokenizer_alignment
from .bpe import bpe_decode, bpe_encode
from .common import table
from .embedding_dedup import audited
from .line_dedup import line_dedup
from .merkle import folded_root, leaf_digest, merkle_manifest, proof_digest
from .mixing import mix_sources
from .ngram_jaccard import ngram_jaccard_join
from .quality_classifier import quality_classifier
from .quality_rules import quality_rules
from .sentencepiece_lattice import sentencepiece_encode
from .substring_dedup import substring_dedup
from .token_counts import separator_scan, tokenised
from .url_templates import url_templates

RANKS = os.environ.get("TOKEN_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
BYTES = os.environ.get("BYTE_BPE", "/opt/tokenizers/byte_bpe_50k.json")
PIECES = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = ngram_jaccard_join(table(spark, sf_dir, "documents"))
    return members.select("doc_id", "n_shingles", "component_id", "class_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines in all, and the length and digest of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    _, kept = line_dedup(docs.withColumn("n_lines", F.size(F.split("text", "\n"))))
    return kept.select("doc_id", "n_lines", F.length("text").alias("n_chars_kept"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix_sources(docs).select("mix_position", "mix_epoch", "doc_id", "source")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_encode(table(spark, sf_dir, "documents"), PIECES)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = substring_dedup(table(spark, sf_dir, "documents"))
    return out


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates(table(spark, sf_dir, "pages"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted by separator in flat files of the whole corpus."""
    counts = separator_scan(tokenised(table(spark, sf_dir, "documents"), RANKS), extra="ids")
    return counts.select(F.explode(F.arrays_zip(F.col("extra").alias("doc_id"), F.col("counts").alias("n_tokens"))).alias("x")).select("x.doc_id", "x.n_tokens")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number and digest of its ids, and the digest of what they decode to."""
    both = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), BYTES), BYTES)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof under the root of the corpus, and whether it holds for the document as it is found: one in seven ids has
    its n_chars tampered with."""
    told = ["doc_id", "source", "lang", "n_chars", "text"]
    leaf = leaf_digest(*map(F.col, told))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = F.when(hit, leaf_digest(*(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in told)))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", leaf.alias("leaf"), found.alias("found"))
    out = merkle_manifest(rows, group="lang", order="doc_id")
    out = out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded_root(F.coalesce("found", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens, groups and links of the two tokenizers, how common its links are, and the digest of its groups."""
    documents, _ = cross_tokenizer_alignment(table(spark, sf_dir, "documents"), BYTES, PIECES)
    digest = F.when(F.col("n_groups") == 0, F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return documents.withColumn("groups_sha256", digest).drop("groups")


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op8_token_counts": op8_token_counts,
    "op2_quality_classifier": op2_quality_classifier,
    "op5_url_templates": op5_url_templates,
    "op6_substring_dedup": op6_substring_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op7_mixing": op7_mixing,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op4_quality_rules": op4_quality_rules,
    "op13_bpe": op13_bpe,
    "op11_alignment": op11_alignment,
    "op12_merkle_manifest": op12_merkle_manifest,
}

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"



def _leaf(n_chars: str) -> str:
    told = [f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(told)})"


# CRC-32 by its definition: a byte is added to the remainder, which is shifted eight times
_STEP = "case when s % 2 = 1 then xor(s // 2, 3988292384) else s // 2 end"
_CRC32 = f"""xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
  lambda r, b: list_reduce(list_prepend(xor(r, b), [0::bigint for i in range(8)]), lambda s, z: {_STEP})), 4294967295)"""

ORACLE: dict[str, str] = {
    "op12_merkle_manifest": f"""
with recursive d as (select row_number() over () as rid, doc_id, coalesce('=' || lang, '') as run, {_leaf("n_chars")} as leaf,
  case when {_CRC32} % 7 = 0 then {_leaf("(n_chars + 1)")} else {_leaf("n_chars")} end as found from documents),
r as (select *, row_number() over (partition by run order by doc_id nulls first, leaf, rid) - 1 as pos, count(*) over (partition by run) as n from d),
t as (select run, 0 as lvl, pos, leaf as h, n from r
  union all select run, lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (n + 1) // 2 from t where n > 1 group by run, lvl, pos // 2, n),
s as (select run, h as subroot, row_number() over (order by run) - 1 as pos, count(*) over () as n, lvl as height from t where n = 1),
u as (select 0 as lvl, pos, subroot as h, n from s
  union all select lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (n + 1) // 2 from u where n > 1 group by lvl, pos // 2, n),
steps as (select rid, l.lvl as step, r.pos >> l.lvl as pos, run, 0 as upper from r join (select distinct run, lvl from t where n > 1) l using (run)
  union all select rid, height + l.lvl, s.pos >> l.lvl, '', 1 from r join s using (run), (select distinct lvl from u where n > 1) l),
nodes as (select run, lvl, pos, h, 0 as upper from t union all select '', lvl, pos, h, 1 from u),
heights as (select rid, height from r join s using (run)),
path as (select rid, step, p.pos % 2 as side, coalesce(k.h, '') as sib from steps p join heights using (rid)
  left join nodes k on k.upper = p.upper and k.run = p.run and k.lvl = step - height * p.upper and k.pos = xor(p.pos, 1)),
f as (select rid, 0 as step, found as h from r
  union all select f.rid, f.step + 1, sha256(case when side = 1 then sib || f.h else f.h || sib end) from f join path using (rid, step)),
top as (select rid, max_by(h, step) as folded_root from f group by rid),
proof as (select rid, sha256(string_agg(sib, '' order by step)) as p from path group by rid)
select doc_id, leaf, subroot, root, coalesce(p, sha256('')) as proof_sha256, folded_root, folded_root = root as verified
from r join s using (run) join top using (rid) left join proof using (rid), (select h as root from u where n = 1)""",
    "op6_substring_dedup": f"""
with w as (select doc_id, {_WORDS.format("coalesce(text, '')")} as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w where len(ws) >= 13)),
first as (select k, min(doc_id) as d from win group by k),
gone as (select distinct win.doc_id, i + j as p from win join first using (k), range(0, 13) r(j) where d < win.doc_id),
each as (select doc_id, unnest(range(1, len(ws) + 1)) as p, unnest(ws) as word from w),
kept as (select e.doc_id, string_agg(word, ' ' order by p) as t, count(*) as n from each e anti join gone g on g.doc_id = e.doc_id and g.p = e.p group by e.doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id)""",
    "op10_ngram_jaccard": f"""
with recursive w as (select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n, sha256(string_agg(g, '|' order by g)) as h from s group by doc_id),
c as (select *, min(doc_id) over (partition by h) as class_id from n),
r as (select s.* from s join c using (doc_id) where doc_id = class_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from r a join r b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
e as (select a, b from l union select b, a from l),
t as (select doc_id as a, doc_id as b from c where doc_id = class_id union select t.a, e.b from t join e on e.a = t.b),
m as (select a, min(b) as component_id from t group by a)
select w.doc_id, coalesce(c.n, 0)::bigint as n_shingles, coalesce(component_id, w.doc_id) as component_id, coalesce(class_id, w.doc_id) as class_id
from w left join c using (doc_id) left join m on m.a = c.class_id""",
}
