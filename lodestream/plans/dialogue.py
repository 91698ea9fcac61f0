"""Conversations, feedback, prompts, telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conversation as C
from ..operators import evaluation as E
from ..operators import feedback as FB
from ..operators import generation as G
from ..operators import metrics as M
from ..streaming.state import drained, session_memory, with_state_store
from .registry import query, table
from .retrieval import _bm25, asked, chunks, index


def messages(spark, d):
    return table(spark, d, "conversations")


@query("conversation_stats", """
select conv_id, count(*) as messages, sum(greatest(1, length(text) // 4))::bigint as total_tokens, least(count(*) filter (where role = 'user'), count(*) filter (where role = 'assistant')) as turn_count,
 arg_max(text, turn) filter (where role = 'user') as last_user, arg_max(text, turn) filter (where role = 'assistant') as last_assistant from conversations group by conv_id""")
def conversation_stats(spark, d):
    return C.stats(messages(spark, d))


@query("conversation_recent", "select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r <= 3")
def conversation_recent(spark, d):
    return C.recent(messages(spark, d), 3).select("conv_id", "turn", "role")


@query("conversation_context", """
with m as (select *, row_number() over (partition by conv_id, role = 'system' order by turn desc) as r from conversations)
select conv_id, turn, row_number() over (partition by conv_id order by role = 'system' desc, turn)::int as place from m where role = 'system' or r <= 4""")
def conversation_context(spark, d):
    return C.context(messages(spark, d), 2).select("conv_id", "turn", "place")


_COMPACT = """
with m as (select *, greatest(1, length(text) // 4) as t, row_number() over (partition by conv_id, role = 'system' order by turn desc) as r from conversations),
k as (select * from m where role = 'system' or r <= 6),
s as (select *, sum(case when role = 'system' then t else 0 end) over (partition by conv_id) as fixed, sum(case when role = 'system' then 0 else t end) over (partition by conv_id order by turn desc rows unbounded preceding) as later from k)
select conv_id, turn from s where role = 'system' or fixed + later <= 120"""


@query("conversation_compact", _COMPACT)
def conversation_compact(spark, d):
    return C.compact(messages(spark, d), 3, 120).select("conv_id", "turn")


@query("conversation_memory_stream", _COMPACT)
def conversation_memory_stream(spark, d):
    """The same memory, kept by a stream of the messages file by file."""
    own = with_state_store(spark)
    schema = table(own, d, "conversations").schema
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{d}/conversations.parque[t]")  # a file or a folder
    out = drained(session_memory(stream, 3, 120))
    last = out.groupBy("conv_id").agg(F.max("version").alias("version"))
    return out.join(last, ["conv_id", "version"], "left_semi").where("turn is not null").select("conv_id", "turn")


@query("conversation_formatted", """
with m as (select *, row_number() over (partition by conv_id, role = 'system' order by turn desc) as r from conversations)
select conv_id, string_agg(upper(role) || ': ' || text, chr(10) order by role = 'system' desc, turn) as context from m where role = 'system' or r <= 4 group by conv_id""")
def conversation_formatted(spark, d):
    return C.formatted(messages(spark, d), 2)


def _follow_ups(spark, d):
    c = messages(spark, d).select("conv_id").distinct()
    return c.withColumn("query", F.when(F.col("conv_id") % 2 == 0, "Tell me more").otherwise("What is it?"))


@query("conversation_standalone", """
with u as (select conv_id, trim(substr(arg_max(text, turn) filter (where role = 'user'), 1, 60)) as hint from conversations group by conv_id)
select conv_id, case when conv_id % 2 = 1 then 'What is it?' when coalesce(hint, '') = '' or contains('tell me more', lower(hint)) then 'Tell me more' else 'Tell me more (in the context of: ' || hint || ')' end as standalone from u""")
def conversation_standalone(spark, d):
    return C.standalone(messages(spark, d), _follow_ups(spark, d)).select("conv_id", "standalone")


@query("conversation_contextualised", """
with m as (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations where role <> 'system'),
b as (select conv_id, string_agg(case role when 'user' then 'Previous question: ' || text when 'assistant' then 'Previous answer: ' || case when length(text) > 200 then substr(text, 1, 200) || '...' else text end end, chr(10) order by turn) as block from m where r <= 6 group by conv_id),
q as (select distinct conv_id, case when conv_id % 2 = 0 then 'Tell me more' else 'What is it?' end as query from conversations)
select conv_id, case when block is null then query else block || chr(10) || chr(10) || 'Current question: ' || query end as contextualised from q left join b using (conv_id)""")
def conversation_contextualised(spark, d):
    return C.contextualised(messages(spark, d), _follow_ups(spark, d)).select("conv_id", "contextualised")


# feedback: every event is a judgement of the chunk numbered by its user
def _events(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "thumbs_up").when(F.col("event_type") == "error", "thumbs_down").when(F.col("event_type") == "click", "click").otherwise("rating")
    score = FB.score_of(kind, (F.col("event_id") % 11) / 10, F.col("event_id") % 7)
    return e.select(F.concat(F.lit("q"), (F.col("user_id") % 3).cast("string")).alias("query"), (F.col("user_id") % 50).alias("chunk_id"), score.alias("score"), "ts")


_EV = """e as (select 'q' || (user_id % 3) as query, user_id % 50 as chunk_id, case event_type when 'purchase' then 1.0::double when 'error' then 0.0::double when 'click' then 1.0::double / (1 + event_id % 7) else (event_id % 11)::double / 10 end as score from events)"""


@query("feedback_per_chunk", f"with {_EV} select chunk_id, round(avg(score), 6) as mean_score, round(avg(case when score >= 0.5 then 1.0 else 0.0 end), 6) as positive_rate, count(*) as events from e group by chunk_id")
def feedback_per_chunk(spark, d):
    return FB.per_chunk(_events(spark, d)).withColumn("mean_score", F.round("mean_score", 6)).withColumn("positive_rate", F.round("positive_rate", 6))


@query("feedback_rerank", f"""
with {_EV}, o as (select query, chunk_id, avg(score) as own from e group by all), a as (select chunk_id, avg(score) as alls from e group by all),
r as (select 'q' || (doc_id % 3) as query_id, doc_id as chunk_id, 0.1 + (doc_id % 10) / 12.5::double as score from documents),
j as (select r.query_id, r.chunk_id, r.score, coalesce(own, alls) as f from r left join o on o.query = r.query_id and o.chunk_id = r.chunk_id left join a on a.chunk_id = r.chunk_id),
s as (select query_id, chunk_id, round(case when f >= 0.6 then least(1.0, score + 0.2) when f <= 0.4 then greatest(0.0, score - 0.3) else score end, 6) as score from j),
k as (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from s) select * from k where rank <= 10""")
def feedback_rerank(spark, d):
    r = table(spark, d, "documents").select(F.concat(F.lit("q"), (F.col("doc_id") % 3).cast("string")).alias("query_id"), F.col("doc_id").alias("chunk_id"), (0.1 + (F.col("doc_id") % 10) / 12.5).alias("score"))
    return FB.rerank(r.withColumn("query", F.col("query_id")).withColumn("rank", F.lit(0)), _events(spark, d)).select("query_id", "chunk_id", "score", "rank")


@query("metrics_histograms", """
with n as (select event_type as name, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events)
select name, count(*) as count, round(sum(value), 4) as total, min(value) as min, max(value) as max, round(avg(value), 6) as mean, max(value) filter (where i = least(n * 50 // 100, n - 1)) as p50, max(value) filter (where i = least(n * 95 // 100, n - 1)) as p95, max(value) filter (where i = least(n * 99 // 100, n - 1)) as p99 from n group by name""")
def metrics_histograms(spark, d):
    h = M.histograms(table(spark, d, "events").select(F.col("event_type").alias("name"), "value"))
    return h.withColumn("total", F.round("total", 4)).withColumn("mean", F.round("mean", 6))


@query("metrics_counters", "select event_type as name, user_id % 5 as shard, round(sum(value), 4) as total from events group by all")
def metrics_counters(spark, d):
    p = table(spark, d, "events").select(F.col("event_type").alias("name"), "value", (F.col("user_id") % 5).alias("shard"))
    return M.counters(p, "shard").withColumn("total", F.round("total", 4))


@query("metrics_gauges", "select event_type as name, arg_max(value, event_id) as last from events group by 1")
def metrics_gauges(spark, d):
    return M.gauges(table(spark, d, "events").select(F.col("event_type").alias("name"), "value", "event_id"), order="event_id")


@query("cost_report", """
with u as (select case user_id % 3 when 0 then 'gpt-4o' when 1 then 'gpt-4' else 'other' end as model, event_id % 1000 as p, event_id % 77 as c from events),
k as (select model, p, c, case model when 'gpt-4o' then p / 1000 * 0.005 + c / 1000 * 0.015 when 'gpt-4' then p / 1000 * 0.03 + c / 1000 * 0.06 else 0 end as cost from u)
select model, count(*) as calls, sum(p)::bigint as prompt_tokens, sum(c)::bigint as completion_tokens, round(sum(cost)::double, 6) as cost from k group by rollup (model)""")
def cost_report(spark, d):
    e = table(spark, d, "events")
    model = F.when(F.col("user_id") % 3 == 0, "gpt-4o").when(F.col("user_id") % 3 == 1, "gpt-4").otherwise("other")
    u = e.select(model.alias("model"), (F.col("event_id") % 1000).alias("prompt_tokens"), (F.col("event_id") % 77).alias("completion_tokens"))
    return M.cost_report(u).withColumn("cost", F.round("cost", 6))


@query("batch_report", "select count(*) as queries, count(*) filter (where event_type = 'error') as failed, round(avg(case when event_type = 'error' then 0.0 else 1.0 end), 6) as success_rate, round(avg(value), 6) as avg_latency_ms from events")
def batch_report(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_type") == "error", "failed").alias("error"), F.col("value").alias("latency_ms"))
    return M.batch_report(e).withColumn("success_rate", F.round("success_rate", 6)).withColumn("avg_latency_ms", F.round("avg_latency_ms", 6))


def _ranked(spark, d):
    c = chunks(spark, d)
    return index(spark, d).top_k(asked(spark, d), 5).join(c.select("chunk_id", "content"), "chunk_id")


@query("prompt_context", f"""
with t as ({_bm25(k=5)}), e as (select query_id, rank, '[Source ' || rank || ']' as label, trim(text) as passage, '[Source ' || rank || ']' || chr(10) || trim(text) as entry from t join documents on doc_id = chunk_id),
b as (select *, coalesce(sum(length(entry) + 2) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) as before from e),
f as (select *, before + length(entry) <= 3000 as fits from b), g as (select *, sum(case when fits then 0 else 1 end) over (partition by query_id order by rank) as cut from f),
l as (select query_id, rank, case when cut = 0 then entry when cut = 1 and not fits and 3000 - before > 100 then label || chr(10) || substr(passage, 1, (3000 - before - length(label) - 5)::bigint) || '...' end as line from g)
select query_id, coalesce(string_agg(line, chr(10) || chr(10) order by rank), '') as context from l group by query_id""")
def prompt_context(spark, d):
    return G.context_block(_ranked(spark, d), 3000)


@query("answer_mock", """
select item_id as query_id, 'This is a mock response to: ' || case when contains(t, '''') and not contains(t, '"') then '"' || t || '"' else '''' || replace(t, '''', chr(92) || '''') || '''' end || '. No real LLM was called; this text is generated deterministically by MockLLM for testing purposes.' as answer
from (select item_id, replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't') as t from benchmark)""")
def answer_mock(spark, d):
    return asked(spark, d).select("query_id", G.mock_answer(F.col("query")).alias("answer"))


@query("answer_stream", "select item_id as query_id, count(*) as chunks, string_agg(substr(text, (i * 7 + 1)::bigint, 7), '' order by i) as text from benchmark, range(0, 100000) r(i) where i * 7 < length(text) group by item_id")
def answer_stream(spark, d):
    a = asked(spark, d).select("query_id", F.col("query").alias("answer"))
    return G.collected(G.stream(a, 7), "query_id")


def _cited(spark, d):
    t = table(spark, d, "benchmark")
    text = F.concat("text", F.lit(" [Source "), (F.col("item_id") % 7).cast("string"), F.lit("] and  [source 2]."))
    return t.select("item_id", text.alias("answer"), F.lit(4).alias("n_sources"))


@query("citations", r"""
with t as (select item_id, item_id % 7 as n, text || ' [Source ' || (item_id % 7) || '] and  [source 2].' as answer from benchmark),
m as (select *, list_sort(list_distinct(list_transform(regexp_extract_all(answer, '(?i)\[source\s+(\d+)\]', 1), lambda x: x::int))) as m from t)
select item_id, array_to_string(list_filter(m, lambda x: x between 1 and 4), ',') as cited, array_to_string(list_filter(m, lambda x: x < 1 or x > 4), ',') as unknown, array_to_string(list_filter([1, 2, 3, 4], lambda x: not list_contains(m, x)), ',') as uncited,
 trim(regexp_replace(regexp_replace(answer, '(?i)\[source\s+(\d+)\]', '', 'g'), '[ \t]{2,}', ' ', 'g')) as clean_text from m""")
def citations(spark, d):
    c = G.cited(_cited(spark, d))
    return c.select("item_id", *[F.array_join(F.col(x).cast("array<string>"), ",").alias(x) for x in ("cited", "unknown", "uncited")], "clean_text")


def _cited_whole(spark, d):
    """All items, with their whole texts."""
    text = F.concat("text", F.lit(" [Source "), (F.col("item_id") % 7).cast("string"), F.lit("] and  [source 2]."))
    return table(spark, d, "benchmark").select("item_id", text.alias("answer"))


@query("citation_spans", r"""
with t as (select item_id, item_id % 7 as n, text, text || ' [Source ' || (item_id % 7) || '] and  [source 2].' as answer from benchmark),
w as (select *, unnest(regexp_extract_all(answer, '(?i)\[source\s+\d+\]')) as whole, unnest(range(0, len(regexp_extract_all(answer, '(?i)\[source\s+\d+\]')))) as i, regexp_split_to_array(answer, '(?i)\[source\s+\d+\]') as parts, regexp_extract_all(answer, '(?i)\[source\s+\d+\]') as wholes from t),
s as (select *, list_sum(list_transform(parts[1:(i + 1)::bigint], lambda x: length(x))) + coalesce(list_sum(list_transform(wholes[1:i::bigint], lambda x: length(x))), 0) as start from w)
select item_id, regexp_extract(whole, '\d+')::int as number, start::int as start, (start + length(whole))::int as end from s""")
def citation_spans(spark, d):
    return _cited_whole(spark, d).select("item_id", F.explode(G.marker_spans(F.col("answer"))).alias("m")).select("item_id", "m.*")


# answers are the assistant's turns, judged against the question before and the benchmark item of the same number
def _samples(spark, d):
    c = messages(spark, d)
    a = c.where("role = 'assistant'").select("conv_id", F.col("turn"), F.col("text").alias("answer"))
    q = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("conv_id"), F.col("text").alias("reference"))
    s = a.join(q, ["conv_id", "turn"]).join(b, "conv_id", "left")
    return s.select(F.concat_ws("#", "conv_id", "turn").alias("sample_id"), "question", F.array("question", F.coalesce("reference", F.lit(""))).alias("contexts"), "answer", "reference")


_TOK = r"regexp_extract_all(lower(coalesce({0}, '')), '([\p{{L}}\p{{N}}_]+)', 1)"
_EXACT = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s\p{{Z}}]', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"
_EVAL = f"""
with a as (select conv_id, turn, text as answer from conversations where role = 'assistant'), q as (select conv_id, turn + 1 as turn, text as question from conversations where role = 'user'),
s as (select a.conv_id || '#' || a.turn as sample_id, question, answer, b.text as reference from a join q using (conv_id, turn) left join benchmark b on b.item_id = a.conv_id),
t as (select *, {_TOK.format('question')} as tq, {_TOK.format('answer')} as ta, {_TOK.format('reference')} as tr from s),
u as (select *, list_distinct(list_concat(tq, tr)) as pool, list_distinct(tq) as dq, list_distinct(ta) as da, list_distinct(tr) as dr, list_distinct(list_concat(tq, ta)) as qa from t),
m as (select sample_id, case when len(ta) = 0 then 1.0 else len(list_filter(ta, lambda x: list_contains(pool, x)))::double / len(ta) end as faithfulness,
 (case when len(qa) = 0 and len(dq) = 0 then 1.0 else (case when len(list_intersect(dq, qa))::double / greatest(1, len(list_distinct(list_concat(dq, qa)))) >= 0.05 then 1 else 0 end) end
  + case when len(list_intersect(dr, qa))::double / greatest(1, len(list_distinct(list_concat(dr, qa)))) >= 0.05 then 1 else 0 end) / 2.0::double as context_precision,
 case when len(tr) > 0 then len(list_filter(tr, lambda x: list_contains(pool, x)))::double / len(tr) when len(ta) = 0 then 1.0 else len(list_filter(ta, lambda x: list_contains(pool, x)))::double / len(ta) end as context_recall,
 case when len(dq) + len(da) = 0 then 1.0 else len(list_intersect(dq, da))::double / len(list_distinct(list_concat(dq, da))) end as answer_relevance,
 case when coalesce(reference, '') = '' then 0.0 when len(list_intersect(da, dr)) = 0 then 0.0 else 2.0::double * len(list_intersect(da, dr)) / (len(da) + len(dr)) end as token_f1,
 case when coalesce(reference, '') = '' then 0.0 when {_EXACT.format('answer')} = {_EXACT.format('reference')} then 1.0 else 0.0 end as exact_match from u)
"""


@query("answer_metrics", _EVAL + "select sample_id, round(faithfulness, 6) as faithfulness, round(context_precision, 6) as context_precision, round(context_recall, 6) as context_recall, round(answer_relevance, 6) as answer_relevance, round(token_f1, 6) as token_f1, exact_match::double as exact_match from m")
def answer_metrics(spark, d):
    m = E.answer_metrics(_samples(spark, d))
    return m.select("sample_id", *[F.round(c, 6).alias(c) for c in E.METRICS])


@query("answer_report", _EVAL + "select metric, round(avg(value), 6) as mean from (unpivot (select faithfulness::double as faithfulness, context_precision::double as context_precision, context_recall::double as context_recall, answer_relevance::double as answer_relevance, exact_match::double as exact_match, token_f1::double as token_f1 from m) on faithfulness, context_precision, context_recall, answer_relevance, exact_match, token_f1 into name metric value value) group by metric")
def answer_report(spark, d):
    return E.answer_report(E.answer_metrics(_samples(spark, d)))


@query("feedback_log", f"with {_EV} select query, chunk_id, score from e")
def feedback_log(spark, d):
    """Events appended to a log of JSON lines in two parts, and read again."""
    import uuid

    from ..operators.tables import shared_dir

    e = _events(spark, d).select("query", "chunk_id", "score")
    path = f"{shared_dir(spark)}/lodestream/feedback-{uuid.uuid4().hex}"
    FB.record(e.where("chunk_id % 2 = 0"), path)
    FB.record(e.where("chunk_id % 2 <> 0"), path)
    return FB.load(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema))


@query("feedback_of_query", f"with {_EV} select chunk_id, score from e where query = 'q1' and chunk_id = 1")
def feedback_of_query(spark, d):
    return FB.for_query_and_chunk(_events(spark, d), "q1", 1).select("chunk_id", "score")


@query("conversation_added", """
select conv_id, turn, role, text from conversations
union all select conv_id, max(turn) + 1 + p, 'user', 'more ' || p from conversations, range(0, 2) r(p) group by conv_id, p""")
def conversation_added(spark, d):
    m = messages(spark, d)
    new = m.select("conv_id").distinct().select("conv_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("place"))
    return C.added(m, new.select("conv_id", "place", F.lit("user").alias("role"), F.concat(F.lit("more "), F.col("place").cast("string")).alias("text")))


@query("messages_by_role", "select conv_id, turn from conversations where role = 'assistant'")
def messages_by_role(spark, d):
    return C.by_role(messages(spark, d), "assistant").select("conv_id", "turn")


@query("answer_responses", "select item_id as query_id, text, ceil(length(text) / 7.0)::bigint as chunks, 'stop' as finish_reason, true as complete from benchmark where length(text) > 0")
def answer_responses(spark, d):
    a = asked(spark, d).select("query_id", F.col("query").alias("answer"))
    r = G.to_response(G.stream(a, 7), "query_id", "mock")
    return r.select("query_id", "text", "chunks", "finish_reason", G.is_complete(F.col("finish_reason")).alias("complete"))
