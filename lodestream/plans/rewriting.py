"""Query rewriting, routing and multi-way retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advanced as A
from ..operators import queries as Q
from .registry import query, table
from .retrieval import asked, chunks, index

ASKS = (
    "What is the {w}?", "how do {w} and {w2} compare to each other", "Explain the concept of {w}", "definition of {w}", "list all cases about {w} since 1999",
    "What's the difference between {w} vs. {w2}; don't they differ?", "who is {w}", 'steps to file a "{w} {w2}" form', "{w} {w2} using {w}", "What are {w} in {w2}?",
)


def questions(spark, d):
    """Questions made of the whole texts of the benchmark items, in two halves: ten shapes."""
    words = F.split(F.coalesce("text", F.lit("")), r"\s+")
    half = F.ceil(F.size(words) / 2).cast("int")
    plain = lambda x: F.lower(F.regexp_replace(F.array_join(x, " "), r"[^\p{L} ]", ""))
    b = table(spark, d, "benchmark").select("item_id", plain(F.slice(words, 1, half)).alias("w"), plain(F.slice(words, half + 1, F.size(words))).alias("w2"))
    shape = F.element_at(F.array(*[F.lit(a) for a in ASKS]), (F.col("item_id") % len(ASKS) + 1).cast("int"))
    return b.select(F.col("item_id").alias("query_id"), F.replace(F.replace(shape, F.lit("{w2}"), F.col("w2")), F.lit("{w}"), F.col("w")).alias("query"))


_SHAPES = "[" + ", ".join("'" + a.replace("'", "''") + "'" for a in ASKS) + "]"
_PLAIN = r"lower(regexp_replace(array_to_string({}, ' '), '[^\p{{L}} ]', '', 'g'))"
_Q = rf"""
a as (select item_id, regexp_split_to_array(coalesce(text, ''), '\s+') as ws from benchmark),
b as (select item_id, {_PLAIN.format("ws[1:(len(ws) + 1) // 2]")} as w, {_PLAIN.format("ws[(len(ws) + 1) // 2 + 1:]")} as w2 from a),
q as (select item_id as query_id, replace(replace({_SHAPES}[item_id % {len(ASKS)} + 1], '{{w2}}', w2), '{{w}}', w) as query from b)
"""


def _intent_sql() -> str:
    cases = []
    for name, patterns in Q.INTENTS:
        hits = " + ".join(f"regexp_matches(l, '{p.replace(chr(39), chr(39) * 2)}')::int" for p, _ in patterns)
        cases.append((name, hits))
    intent = "case " + " ".join(f"when {h} > 0 then '{n}'" for n, h in cases) + " else 'unknown' end"
    strong = "case " + " ".join(f"when {h} > 0 then case when {h} >= 2 then 0.9 else 0.6 end" for n, h in cases) + " else 0.0 end"
    return f"with {_Q}, l as (select query_id, lower(trim(query)) as l from q) select query_id, {intent} as intent, ({strong})::double as confidence from l"


@query("query_intent", _intent_sql())
def query_intent(spark, d):
    return Q.classified(questions(spark, d)).select("query_id", "intent", "confidence")


@query("query_decomposed", rf"""
with {_Q}, p as (select query_id, query, list_filter(list_transform(string_split(regexp_replace(query, '{Q.CUTS}', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 5) as parts from q)
select query_id, array_to_string(case when len(parts) > 0 then parts else [query] end, '|') as parts from p""")
def query_decomposed(spark, d):
    return questions(spark, d).select("query_id", F.array_join(Q.decomposed(F.col("query")), "|").alias("parts"))


@query("query_step_back", rf"""
with {_Q}, s as (select query_id, regexp_replace(trim(query), '\?+$', '') as s from q),
c as (select *, list_filter(list_transform([' in ', ' for ', ' using ', ' with ', ' of ', ' about '], lambda c: case when contains(lower(s), c) and trim(left(s, strpos(lower(s), c) - 1)) <> '' then trim(left(s, strpos(lower(s), c) - 1)) end), lambda x: x is not null) as heads, list_filter(string_split(s, ' '), lambda x: x <> '') as words from s)
select query_id, case when len(heads) > 0 then heads[1] when len(words) > 3 then array_to_string(words[2:], ' ') else s end as broader from c""")
def query_step_back(spark, d):
    return questions(spark, d).select("query_id", Q.step_back(F.col("query")).alias("broader"))


@query("query_hypothesis", rf"""
with {_Q}, s as (select query_id, regexp_replace(trim(query), '\?+$', '') as s from q),
r as (select query_id, s, case when starts_with(lower(s), 'what is') then trim(substr(s, 8)) when starts_with(lower(s), 'what are') then trim(substr(s, 9)) end as what,
 case when starts_with(lower(s), 'how does') then trim(substr(s, 9)) when starts_with(lower(s), 'how do') then trim(substr(s, 7)) end as how from s)
select query_id, case when what is not null then upper(left(what, 1)) || lower(substr(what, 2)) || ' is a concept related to ' || lower(what) || '.'
 when how is not null then upper(left(how, 1)) || lower(substr(how, 2)) || ' works by performing the relevant operations.'
 else 'The answer to ''' || s || ''' involves relevant information about the topic.' end as hypothesis from r""")
def query_hypothesis(spark, d):
    return questions(spark, d).select("query_id", Q.hypothesis(F.col("query")).alias("hypothesis"))


@query("query_normalized")
def query_normalized(spark, d):
    n = Q.normalised(questions(spark, d), Q.KEYWORD)
    return n.select("query_id", "normalized", F.array_join("removed_stopwords", " ").alias("removed"), "truncated", "too_short", "script")


@query("query_script", r"""
with n as (select doc_id, length(regexp_replace(text, '[^A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g')) as latin, length(regexp_replace(text, '[^一-鿿぀-ヿ가-힯]', '', 'g')) as cjk, length(regexp_replace(text, '[^؀-ۿ]', '', 'g')) as arabic, length(regexp_replace(text, '[^Ѐ-ӿ]', '', 'g')) as cyrillic from documents)
select doc_id, case when greatest(latin, cjk, arabic, cyrillic) = 0 then 'unknown' when latin >= greatest(cjk, arabic, cyrillic) then 'latin' when cjk >= greatest(arabic, cyrillic) then 'cjk' when arabic >= cyrillic then 'arabic' else 'cyrillic' end as script from n""")
def query_script(spark, d):
    from ..functions.text import script

    return table(spark, d, "documents").select("doc_id", script(F.col("text")).alias("script"))


@query("query_variants")
def query_variants(spark, d):
    return questions(spark, d).select("query_id", F.array_join(Q.variants(F.col("query")), "|").alias("variants"))


@query("query_paraphrases")
def query_paraphrases(spark, d):
    return questions(spark, d).select("query_id", F.array_join(Q.paraphrases(F.col("query")), "|").alias("paraphrases"))


@query("query_synonyms", rf"""
with {_Q}, f as (select query_id, query, list_transform(list_filter(string_split(query, ' '), lambda x: x <> ''), lambda x: regexp_replace(lower(x), '[^\p{{L}}\p{{N}}_]', '', 'g')) as keys from q)
select query_id, case when list_contains(keys, 'form') and not regexp_matches(lower(query), '\bapplication\b') then query || ' application sheet' when list_contains(keys, 'cases') then query || ' lawsuits' else query end as expanded from f""")
def query_synonyms(spark, d):
    s = {"form": ["application", "sheet"], "cases": ["lawsuits", "cases"], "who": ["who"]}
    return Q.with_synonyms(questions(spark, d), s).select("query_id", "expanded")


def _retrieve(spark, d):
    found = index(spark, d)
    return lambda queries, k: found.top_k(queries, k)


@query("query_feedback_terms")
def query_feedback_terms(spark, d):
    c, q = chunks(spark, d), asked(spark, d)
    hits = index(spark, d).top_k(q, 3).join(c.select("chunk_id", "content"), "chunk_id")
    return Q.feedback_terms(hits, q).select("query_id", F.array_join("added", " ").alias("added"))


@query("retrieve_hyde")
def retrieve_hyde(spark, d):
    return A.fused(questions(spark, d), _retrieve(spark, d), "hyde", 5, chunks(spark, d))


@query("retrieve_step_back")
def retrieve_step_back(spark, d):
    return A.fused(questions(spark, d), _retrieve(spark, d), "step_back", 5, chunks(spark, d))


@query("retrieve_multi_query")
def retrieve_multi_query(spark, d):
    return A.fused(questions(spark, d), _retrieve(spark, d), "multi_query", 5, chunks(spark, d))


@query("retrieve_routed")
def retrieve_routed(spark, d):
    return A.routed(questions(spark, d), _retrieve(spark, d), 5)
