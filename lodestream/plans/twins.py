"""SQL twins of queries over ranked results: compression, explanation, depth, diversity, duplicates, fusion with dense lists."""

from __future__ import annotations

from ..functions.text import KEYWORD_STOP
from ..operators.graph import TERMS
from ..operators.queries import CONTRACTIONS, ENGLISH_STOP, FEEDBACK_STOP, PARAPHRASE_STOP, QUESTION_WORDS
from .registry import ORACLE, twin
from .retrieval import _bm25
from .rewriting import _Q
from .text_ops import _LOOSE, _MEASURE, _WORD


def _in(words: tuple[str, ...]) -> str:
    return "(" + ",".join(f"'{w}'" for w in words) + ")"


def _letter_words(text: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+'), lambda z: regexp_full_match(z, '[a-z]{{2,}}'))"


def _keywords(text: str) -> str:
    return f"list_sort(list_distinct(list_filter({_letter_words(text)}, lambda y: y not in {_in(KEYWORD_STOP)})))"


def _sentences(text: str) -> str:
    ends = rf"regexp_replace({text}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
    cut = rf"string_split(regexp_replace({ends}, '([.!?])[\s\p{{Z}}]+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))"
    return rf"list_filter(list_transform({cut}, lambda x: regexp_replace(x, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), lambda x: x <> '')"


def _ranked(k: int) -> str:
    """t, and j: the k best documents of every benchmark item with both texts."""
    return (
        f"t as ({_bm25(k=k)}), j as (select t.query_id, t.chunk_id, t.score, t.rank, b.text as query, x.text as content"
        " from t join benchmark b on b.item_id = t.query_id join documents x on x.doc_id = t.chunk_id)"
    )


twin("explain_results", f"""
with {_ranked(5)}, k as (select *, {_keywords('query')} as kw, {_letter_words('content')} as words from j),
m as (select *, list_filter(kw, lambda x: list_contains(words, x)) as got from k),
o as (select *, case when len(kw) = 0 then 0.0::double else len(got)::double / len(kw) end as share from m)
select query_id, chunk_id, rank, score, array_to_string(got, ',') as matched_terms, round(share, 6) as overlap,
 '#' || rank || ' score=' || round(score::decimal(18, 6), 4) || ' terms=' || floor(share * 100 + 0.5)::int || '%' as summary from o""")

twin("compress_keywords", f"""
with {_ranked(5)}, s as (select *, {_sentences('content')} as s, {_keywords('query')} as kw from j),
a as (select *, list_filter(s, lambda x: len(list_intersect(kw, {_letter_words('x')})) > 0) as above from s),
r as (select *, case when len(above) < 1 then s[1:1] else above end as retained from a),
c as (select *, array_to_string(retained, ' … ') as compressed from r)
select query_id, chunk_id, compressed, round(length(compressed)::double / greatest(length(content), 1), 6) as ratio,
 round(case when len(s) = 0 then 0.0::double else len(retained)::double / len(s) end, 6) as relevance from c""")

_WORDS = f"list_distinct(list_filter({_letter_words('x')}, lambda w: w not in {_in(KEYWORD_STOP)}))"
_SCORE = (
    f"case when len(kw) = 0 or len({_WORDS}) = 0 then 0.0::double else least(1.0::double, len(list_intersect(kw, {_WORDS}))::double"
    f" / len(list_distinct(list_concat(kw, {_WORDS}))) + 0.1::double * ln(len({_WORDS}) + 1) / 5.0::double) end"
)
twin("compress_sentences", f"""
with {_ranked(5)}, s as (select *, {_sentences('content')} as s, {_keywords('query')} as kw from j),
v as (select *, list_transform(s, lambda x: round({_SCORE}, 12)) as v from s),
a as (select *, list_filter(s, lambda y, i: v[i] >= 0.12) as above from v),
r as (select *, case when len(s) = 0 then [] when len(above) < 1 then [s[list_position(v, list_max(v))]] else above end as retained from a),
c as (select *, case when len(s) = 0 then content else array_to_string(retained, ' … ') end as compressed from r),
g as (select *, {_sentences('compressed')} as again from c)
select query_id, chunk_id, compressed, round(length(compressed)::double / greatest(length(content), 1), 6) as ratio,
 round(case when len(again) = 0 then 0.0::double else list_sum(list_transform(again, lambda x: {_SCORE})) / len(again) end, 6) as relevance from g""")

twin("adaptive_depth", f"""
with {_ranked(20)}, q as (select item_id as query_id, {_keywords('text')} as kw from benchmark),
h as (select q.query_id, rank, score, list_filter(kw, lambda x: list_contains(words, x)) as terms from q join (select query_id, rank, score, {_letter_words('content')} as words from j) using (query_id)),
d as (select unnest([3, 6, 12, 20]) as k),
c as (select q.query_id, any_value(kw) as kw, k, len(list_distinct(flatten(list(coalesce(terms, []))))) as got, count(rank) as n, max(score) - min(score) as width from q cross join d left join h on h.query_id = q.query_id and h.rank <= d.k group by q.query_id, k),
v as (select query_id, k, case when len(kw) = 0 then 1.0::double else got::double / len(kw) end as coverage, case when n < 2 then 0.0::double else width end as spread from c),
r as (select *, case when k >= 20 then 'max_k' when k > 3 and spread < 0.01 then 'low_spread' when coverage >= 0.6 then 'coverage_met' else 'expand' end as reason from v)
select query_id, k as final_k, round(coverage, 6) as coverage, round(spread, 6) as spread, reason from r where reason <> 'expand' qualify row_number() over (partition by query_id order by k) = 1""")


def _vector(text: str, n: int) -> str:
    hashed = f"unhex(sha256({text}))"
    raw = f"list_transform(range(0, {n}), lambda i: ('0x' || substr(sha256({hashed} || unhex(lpad(printf('%x', i), 8, '0'))), 1, 8))::bigint / 4294967295.0::double * 2.0::double - 1.0::double)"
    return f"list_transform({raw}, lambda y: y / sqrt(list_sum(list_transform({raw}, lambda x: x * x))))"


_SIM = "list_sum(list_transform(range(1, 17), lambda i: {a}[i] * {b}[i]))"
_VECTORS = f"{_ranked(10)}, e as (select query_id, chunk_id, score, rank as i, {_vector('content', 16)} as e, {_vector('query', 16)} as q from j)"
_PAIRS = f"p as (select a.query_id, a.i, b.i as j, {_SIM.format(a='a.e', b='b.e')} as s from e a join e b using (query_id))"


def _mmr(k: int) -> str:
    steps = []
    for n in range(1, k + 1):
        before = " union all ".join(f"select query_id, i from c{m}" for m in range(1, n))
        if n == 1:
            steps.append("c1 as (select query_id, i, 1 as step from m qualify row_number() over (partition by query_id order by round(0.5 * sim, 12) desc, i) = 1)")
        else:
            steps.append(f"b{n} as ({before}), n{n} as (select p.query_id, p.i, max(p.s) as near from p join b{n} b on b.query_id = p.query_id and b.i = p.j group by p.query_id, p.i)")
            steps.append(f"c{n} as (select m.query_id, m.i, {n} as step from m join n{n} n using (query_id, i) anti join b{n} b on b.query_id = m.query_id and b.i = m.i qualify row_number() over (partition by m.query_id order by round(0.5 * sim - 0.5 * near, 12) desc, m.i) = 1)")
    chosen = " union all ".join(f"select * from c{n}" for n in range(1, k + 1))
    return f"with {_VECTORS}, {_PAIRS}, m as (select query_id, chunk_id, i, {_SIM.format(a='e', b='q')} as sim from e), {', '.join(steps)}, c as ({chosen}) select c.query_id, chunk_id, round(sim, 6) as score, step::int as rank from c join m using (query_id, i)"


twin("mmr_select", _mmr(5))


def _greedy(close: str, first: str, most: int) -> str:
    """k: the kept places of every query, where a place goes if `close` holds with one kept before; needs p (query_id, i, j, s)."""
    steps = ["k1 as (select query_id, i from e where i = 1)"]
    for n in range(2, most + 1):
        steps.append(f"k{n} as (select * from k{n - 1} union all select query_id, i from e where i = {n} and not exists (select 1 from k{n - 1} k join p on p.query_id = k.query_id and p.j = k.i where k.query_id = e.query_id and p.i = {n} and {close}))")
    return f"{first}, {', '.join(steps)}"


twin("greedy_diversify", f"""
with {_greedy('p.s > 0.3', f'{_VECTORS}, {_PAIRS}', 10)}
select query_id, chunk_id, score, row_number() over (partition by query_id order by i)::int as rank from e join k10 using (query_id, i)""")

_GRAMS = f"""u as (select distinct chunk_id, {_LOOSE.format('content')} as t from j),
g as (select chunk_id, case when length(t) = 0 then []::varchar[] when length(t) < 3 then [t] else list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) end as grams from u)"""
_HOME = "select query_id, chunk_id, i::int as rank, coalesce((select min(p.j) from p join {k} k on k.query_id = p.query_id and k.i = p.j where p.query_id = e.query_id and p.i = e.i and p.j < e.i and {close}), i)::int as kept_as from e"
_FAR = "bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo))"
_SIMHASHES = f"""{_ranked(10)}, {_GRAMS}, w as (select chunk_id, md5(unnest(grams)) as m from g),
h as (select chunk_id, ('0x' || substr(m, 17, 8))::bigint as hi, ('0x' || substr(m, 25, 8))::bigint as lo from w),
v as (select chunk_id, b, sum(case when (hi >> b::bigint) & 1 = 1 then 1 else -1 end) as vh, sum(case when (lo >> b::bigint) & 1 = 1 then 1 else -1 end) as vl from h, range(0, 32) r(b) group by chunk_id, b),
z as (select chunk_id, sum(case when vh > 0 then 1::bigint << b else 0 end)::bigint as hi, sum(case when vl > 0 then 1::bigint << b else 0 end)::bigint as lo from v group by chunk_id),
e as (select query_id, chunk_id, rank as i, coalesce(hi, 0) as hi, coalesce(lo, 0) as lo from j left join z using (chunk_id)),
p as (select a.query_id, a.i, b.i as j, {_FAR} as s from e a join e b using (query_id))"""
twin("dedup_simhash_results", f"with {_greedy('p.s <= 3', _SIMHASHES, 10)} {_HOME.format(k='k10', close='p.s <= 3')}")

_SIGNATURES = f"""{_ranked(5)}, {_GRAMS},
z as (select chunk_id, list_transform(range(0, 128), lambda i: coalesce(list_min(list_transform(grams, lambda y: ('0x' || substr(md5(unhex(lpad(printf('%x', i), 2, '0') || '000000') || encode(y)), 1, 8))::bigint)), 4294967295)) as x from g),
e as (select query_id, chunk_id, rank as i, x from j join z using (chunk_id)),
p as (select a.query_id, a.i, b.i as j, len(list_filter(range(1, 129), lambda n: a.x[n] = b.x[n])) / 128.0::double as s from e a join e b using (query_id))"""
twin("dedup_minhash_results", f"with {_greedy('p.s >= 0.8', _SIGNATURES, 5)} {_HOME.format(k='k5', close='p.s >= 0.8')}")

_COS32 = "list_sum(list_transform(range(1, 33), lambda i: q.v[i] * c.v[i])) / (sqrt(list_sum(list_transform(q.v, lambda x: x * x))) * sqrt(list_sum(list_transform(c.v, lambda x: x * x))))"
twin("hybrid_retrieve", f"""
with a as ({_bm25(k=30)}), q as (select item_id as query_id, {_vector('text', 32)} as v from benchmark), c as (select doc_id as chunk_id, {_vector('text', 32)} as v from documents),
s as (select query_id, chunk_id, round({_COS32}, 6) as score from q, c),
b as (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s qualify rank <= 30),
l as (select query_id, chunk_id, rank, 0 as list from a union all select query_id, chunk_id, rank, 1 as list from b),
f as (select query_id, chunk_id, round(sum(1 / (60.0 + rank)::double), 6) as score, list_sort(list(distinct list))::varchar as lists from l group by query_id, chunk_id)
select query_id, chunk_id, score, lists, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from f qualify rank <= 10""")

twin("query_feedback_terms", rf"""
with {_ranked(3)}, w as (select query_id, rank, regexp_extract_all(lower(content), '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+') as ws from j),
x as (select query_id, rank, unnest(ws) as term, unnest(range(0, len(ws))) as place from w),
known as (select item_id as query_id, unnest(regexp_split_to_array(lower(text), '[\s\p{{Z}}]+')) as term from benchmark),
n as (select query_id, term, count(*) as n, min(rank * 10000000 + place) as first from x where length(term) > 2 and term not in {_in(FEEDBACK_STOP)} and (query_id, term) not in (select query_id, term from known) group by query_id, term),
o as (select *, row_number() over (partition by query_id order by n desc, first) as r from n)
select item_id as query_id, coalesce(string_agg(term, ' ' order by r), '') as added from benchmark left join o on o.query_id = item_id and r <= 5 group by item_id""")


_ASKED = f"q as (with {_Q} select query_id, query from q)"
_SPLIT = r"list_filter(regexp_split_to_array({0}, '[\s\p{{Z}}]+'), lambda x: x <> '')"
_TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+')"
_ABOUT = " ".join(f"when starts_with(lower(stem), '{p}') then 'information about ' || trim(substr(stem, {len(p) + 1}))" for p in ("what is", "what are", "how does", "how do", "explain", "describe"))


def _paraphrased(n: int) -> str:
    """(query_id, query, made)"""
    return rf"""select query_id, query, list_filter([case when len(key) > 0 and key <> words then array_to_string(key, ' ') end, case {_ABOUT} end,
 case when len({_SPLIT.format('query')}) <= 4 then 'definition of ' || regexp_replace(lower(query), '\?+$', '') end], lambda v: v is not null and trim(v) <> '' and lower(v) <> lower(query))[1:{n}] as made
 from (select *, list_filter(words, lambda w: w not in {_in(PARAPHRASE_STOP)} and length(w) > 2) as key from (select query_id, query, {_TOKENS.format('query')} as words, regexp_replace(trim(query), '\?+$', '') as stem from q))"""


twin("query_paraphrases", f"with {_ASKED} select query_id, array_to_string(made, '|') as paraphrases from ({_paraphrased(3)})")

twin("query_variants", rf"""
with {_ASKED}, w as (select query_id, query, {_SPLIT.format('query')} as words, trim(regexp_replace(rtrim(query), '[? ]+$', '')) as bare from q),
k as (select *, list_filter(words, lambda x: trim(lower(x), '?.,!') not in {_in(QUESTION_WORDS)}) as key from w),
m as (select query_id, list_filter([trim(query), case when len(key) >= 2 then array_to_string(key, ' ') end, case when len(words) >= 3 and len(key) > 0 then array_to_string(list_reverse(key), ' ') end,
 case when ends_with(rtrim(query), '?') and bare <> query then bare end], lambda v: v is not null) as made from k)
select query_id, array_to_string(list_filter(made, lambda v, i: list_position(list_transform(made, lambda x: lower(x)), lower(v)) = i)[1:4], '|') as variants from m""")


def _contracted(text: str) -> str:
    for k in sorted(CONTRACTIONS, key=lambda x: (-len(x), x)):
        text = f"regexp_replace({text}, '\\b{k.replace(chr(39), chr(39) * 2)}\\b', '{CONTRACTIONS[k]}', 'g')"
    return text


_QUOTED = r"""regexp_replace(query, '"[^"]*"', ' __quoted_0__ ')"""
_SCRIPTS = (("latin", "A-Za-zÀ-ÖØ-öø-ÿ"), ("cjk", "一-鿿぀-ヿ가-힯"), ("arabic", "؀-ۿ"), ("cyrillic", "Ѐ-ӿ"))
_COUNTS = ", ".join(f"length(regexp_replace(query, '[^{r}]', '', 'g')) as {n}" for n, r in _SCRIPTS)
twin("query_normalized", rf"""
with {_ASKED}, t as (select query_id, query, regexp_extract(query, '"([^"]*)"', 1) as phrase, {_contracted(f'lower({_QUOTED})')} as t, {_COUNTS} from q),
w as (select *, list_transform({_SPLIT.format(r"regexp_replace(t, '[^\p{L}\p{M}\p{N}\p{Pc}\s\p{Z}]', ' ', 'g')")}, lambda x: case when x = '__quoted_0__' then trim(phrase) else x end) as words from t),
s as (select *, list_filter(words, lambda x: x in {_in(ENGLISH_STOP)}) as stopped, array_to_string(list_filter(words, lambda x: x not in {_in(ENGLISH_STOP)} and length(x) >= 2), ' ') as normalized from w)
select query_id, normalized, array_to_string(stopped, ' ') as removed, false as truncated, length(normalized) < 2 as too_short,
 case when greatest(latin, cjk, arabic, cyrillic) = 0 then 'unknown' when latin >= greatest(cjk, arabic, cyrillic) then 'latin' when cjk >= greatest(arabic, cyrillic) then 'cjk' when arabic >= cyrillic then 'arabic' else 'cyrillic' end as script from s""")


def _sub_searches(subs: str, k: int, extra: str = "") -> str:
    """subs: rows (query_id, sub, text). The fused results of every query, without repeats of a text after the cut."""
    search = _bm25(k=3 * k).replace("from benchmark", "from (select query_id || '#' || sub as item_id, text from subs)")
    return f"""{extra}subs as ({subs}), r as ({search}),
f as (select s.query_id, r.chunk_id, round(sum(1 / (60.0 + r.rank)::double), 6) as score from r join subs s on s.query_id || '#' || s.sub = r.query_id group by s.query_id, r.chunk_id),
c as (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from f qualify rank <= {k})"""


def _once(name: str) -> str:
    return f"select query_id, chunk_id, score, rank from {name} join documents on doc_id = chunk_id qualify row_number() over (partition by query_id, md5(text) order by rank) = 1"


_HYDE = "select query_id, 0 as sub, hypothesis as text from h union all select query_id, 1, query from q join h using (query_id) where query <> hypothesis"
_BACK = "select query_id, 0 as sub, query as text from q union all select query_id, 1, broader from q join b using (query_id) where lower(broader) <> lower(query)"
_MULTI = f"select query_id, 0 as sub, query as text from q union all select query_id, unnest(range(1, len(made) + 1)), unnest(made) from (select query_id, query, list_distinct(list_filter(made, lambda v: v <> query)) as made from ({_paraphrased(3)}))"
twin("retrieve_hyde", f"with {_ASKED}, h as ({ORACLE['query_hypothesis']}), {_sub_searches(_HYDE, 5)} {_once('c')}")
twin("retrieve_step_back", f"with {_ASKED}, b as ({ORACLE['query_step_back']}), {_sub_searches(_BACK, 5)} {_once('c')}")
twin("retrieve_multi_query", f"with {_ASKED}, {_sub_searches(_MULTI, 5)} {_once('c')}")


def _strategy(subs: str, k: int) -> str:
    return f"(with {_sub_searches(subs, k)} select query_id, chunk_id, score, rank from c)"


def _of(subs: str, *intents: str) -> str:
    return f"select * from ({subs}) where query_id in (select query_id from i where intent in {_in(intents)})".replace(",)", ")")


_FOUR = _MULTI.replace("[1:3] as made", "[1:4] as made")
twin("retrieve_routed", f"""
with {_ASKED}, h as ({ORACLE['query_hypothesis']}), b as ({ORACLE['query_step_back']}), i as ({ORACLE['query_intent']}),
hyde as (select * from {_strategy(_of(_HYDE, 'factual', 'definitional'), 5)}), back as (select * from {_strategy(_of(_BACK, 'procedural'), 5)}),
four as (select * from {_strategy(_of(_FOUR, 'comparative'), 5)}), multi as (select * from {_strategy(_of(_MULTI, 'unknown'), 5)}),
hop as (select * from {_strategy(_of(_MULTI, 'multi_hop'), 15)} union all select * from {_strategy(_of(_BACK, 'multi_hop'), 15)}),
fused as (select query_id, chunk_id, round(sum(1 / (60.0 + rank)::double), 6) as score from hop group by all),
joint as (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from fused qualify rank <= 5),
every as (select * from hyde union all select * from back union all select * from four union all select * from multi union all select * from joint)
select query_id, chunk_id, score, rank, intent, confidence, case intent when 'factual' then 'hyde' when 'definitional' then 'hyde' when 'procedural' then 'step_back' when 'multi_hop' then 'composite[multi_query+step_back]' else 'multi_query' end as strategy from every join i using (query_id)""")


_TRIMMED = r"regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
_START = "case when strpos(substr(text, a.off + 1), p) > 0 then a.off + strpos(substr(text, a.off + 1), p) - 1 else a.off end"


def _split_sentences(least: int) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[\s\p{{Z}}]+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_TRIMMED}), lambda x: x <> '' and length(x) >= {least})"


def _located(parts: str) -> str:
    """Chunks from rows (doc_id, text, parts), each searched for from one past the start of the one before."""
    fold = f"list_reduce(parts, lambda a, p: {{'off': greatest(a.off, {_START} + 1), 'out': list_append(a.out, {{'s': {_START}, 'p': p}})}}, {{'off': 0::bigint, 'out': []::struct(s bigint, p varchar)[]}}).out"
    return f"""select doc_id || '#' || i as chunk_id, doc_id as document_id, i::int as index, c.s::int as start_char, (c.s + length(c.p))::int as end_char, c.p as content
 from (select doc_id, unnest(o) as c, unnest(range(0, len(o))) as i from (select doc_id, {fold} as o from ({parts})))"""


_TAIL = "list_reduce(list_reverse(a.cur), lambda t, x: case when t.stop or t.n + length(x) + 1 > 50 then {'n': t.n, 'stop': true, 'keep': t.keep} else {'n': t.n + length(x) + 1, 'stop': false, 'keep': list_prepend(x, t.keep)} end, {'n': 0::bigint, 'stop': false, 'keep': []::varchar[]}).keep"
_GROWN = "(length(s) + case when len(a.cur) > 0 then 1 else 0 end)"
_PACKED = (
    f"list_reduce(ss, lambda a, s: case when a.n + {_GROWN} > 512 and len(a.cur) > 0 then {{'done': list_append(a.done, array_to_string(a.cur, ' ')), 'cur': list_append({_TAIL}, s),"
    f" 'n': (coalesce(list_sum(list_transform({_TAIL}, lambda y: length(y))), 0) + greatest(len({_TAIL}) - 1, 0) + {_GROWN})::bigint}}"
    f" else {{'done': a.done, 'cur': list_append(a.cur, s), 'n': (a.n + {_GROWN})::bigint}} end, {{'done': []::varchar[], 'cur': []::varchar[], 'n': 0::bigint}})"
)
twin("chunk_sentence", _located(f"select doc_id, text, case when len(g.cur) > 0 then list_append(g.done, array_to_string(g.cur, ' ')) else g.done end as parts from (select doc_id, text, {_PACKED} as g from (select doc_id, text, {_split_sentences(5)} as ss from documents where text is not null))"))

_BAG = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '[\s\p{{Z}}]+'), lambda z: z <> ''))"
_BAGS = f"list_transform(ss, lambda x: {_BAG.format('x')})"
_NEAR = "case when i = 1 or len(list_distinct(list_concat(bags[i - 1], bags[i]))) = 0 then 0.0::double else len(list_intersect(bags[i - 1], bags[i]))::double / len(list_distinct(list_concat(bags[i - 1], bags[i]))) end"
_JOINED = (
    "list_reduce(items, lambda a, x: case when a.cur is not null and length(a.cur) + 1 + length(x.s) <= 512 and x.sim >= 0.3 then {'done': a.done, 'cur': a.cur || ' ' || x.s}"
    " else {'done': case when a.cur is null then a.done else list_append(a.done, a.cur) end, 'cur': x.s} end, {'done': []::varchar[], 'cur': null::varchar})"
)
twin("chunk_semantic", _located(f"select doc_id, text, case when g.cur is null then g.done else list_append(g.done, g.cur) end as parts from (select doc_id, text, {_JOINED} as g from (select doc_id, text, list_transform(ss, lambda x, i: {{'s': x, 'sim': {_NEAR}}}) as items from (select *, {_BAGS} as bags from (select doc_id, text, {_split_sentences(0)} as ss from documents where text is not null))))"))


def _pieces(x: str, level: int = 0) -> str:
    """The parts of at most 512 characters of x: runs between separators, longer parts by the next separator, at last cut hard."""
    seps = ("chr(10) || chr(10)", "chr(10)", "'. '", "' '")
    if level == len(seps):
        return f"list_transform(range(0, length({x}), 512), lambda h: substr({x}, h + 1, 512))"
    a, p, sep = f"a{level}", f"p{level}", seps[level]
    grown = f"case when {a}.run = '' then {p} else {a}.run || {sep} || {p} end"
    deeper = _pieces(p, level + 1)
    step = f"case when length({grown}) <= 512 then {{'done': {a}.done, 'run': {grown}}} else {{'done': list_concat(list_append({a}.done, {a}.run), case when length({p}) <= 512 then [] else {deeper} end), 'run': case when length({p}) <= 512 then {p} else '' end}} end"
    fold = f"list_reduce(string_split({x}, {sep}), lambda {a}, {p}: {step}, {{'done': []::varchar[], 'run': ''::varchar}})"
    return f"case when length({x}) <= 512 then [{x}] else list_transform([{fold}], lambda r{level}: list_append(r{level}.done, r{level}.run))[1] end"


_MERGED = "list_reduce(pieces, lambda a, p: case when a.cur is not null and length(a.cur) + 1 + length(p) <= 512 then {'done': a.done, 'cur': a.cur || ' ' || p} else {'done': case when a.cur is null then a.done else list_append(a.done, a.cur) end, 'cur': p} end, {'done': []::varchar[], 'cur': null::varchar})"
_OVERLAPPED = "list_transform(merged, lambda p, i: case when i > 1 and length(right(merged[i - 1], 50) || ' ' || p) <= 512 then right(merged[i - 1], 50) || ' ' || p else p end)"
twin("chunk_recursive", _located(
    f"select doc_id, text, {_OVERLAPPED} as parts from (select doc_id, text, case when g.cur is null then g.done else list_append(g.done, g.cur) end as merged from (select doc_id, text, {_MERGED} as g"
    rf" from (select doc_id, text, list_filter({_pieces('text')}, lambda v: not regexp_full_match(v, '[\s\p{{Z}}]*')) as pieces from documents where text is not null)))"
))


def _mentions(name: str, key: str, rows: str) -> str:
    """name: (key, doc_id, name) of the first mention of every entity of a row; key names the rows' id."""
    return rf"""{name}_w as (select {key} as doc_id, unnest(ws) as name, unnest(range(0, len(ws))) as i from (select {key}, {_WORD.replace('{0}', 'text')} as ws from {rows})),
{name}_m as (select {key} as doc_id, unnest(ms) as name, unnest(range(0, len(ms))) as i from (select {key}, regexp_extract_all(text, '(?i)\b({_MEASURE})\b', 1) as ms from {rows})),
{name}_u as (select doc_id, name, i from {name}_w where lower(name) in {_in(TERMS)} union all select doc_id, name, 1000000000 + i from {name}_w where regexp_full_match(name, '[A-Z]{{2,8}}s?') union all select doc_id, name, 3000000000 + i from {name}_m),
{name} as (select doc_id, lower(name) as key, arg_min(name, i) as name from {name}_u group by doc_id, lower(name))"""


twin("graph_expanded_queries", rf"""
with recursive {_mentions('d', 'doc_id', 'documents')}, ent as (select key, arg_min(name, doc_id) as name from d group by key),
asks as (select key as item_id, 'more about ' || name as text from ent), {_mentions('b', 'item_id', 'asks')}, known as (select doc_id, list(key) as keys from d group by doc_id),
s as (select doc_id, unnest(regexp_split_to_array(text, '[.!?\n]+')) as t from documents), p as (select list_filter(keys, lambda k: contains(lower(t), k)) as present from s join known using (doc_id)),
e as (select distinct u, v from (select present, unnest(present) as u from p where len(present) >= 2), unnest(present) x(v) where u <> v),
q as (select distinct b.doc_id as query_id, key from b join ent using (key)),
h1 as (select distinct query_id, key, v as node from q join e on e.u = q.key), h2 as (select distinct h1.query_id, h1.key, e.v as node from h1 join e on e.u = h1.node where e.v <> h1.key),
n as (select query_id, key, node, min(hops) as hops from (select *, 1 as hops from h1 union all select *, 2 from h2) group by query_id, key, node),
r as (select query_id, ent.name as name, min(hops) as hops from n join ent on ent.key = n.node group by query_id, ent.name),
t as (select *, row_number() over (partition by query_id order by hops, name) as place from r qualify place <= 10)
select item_id as query_id, coalesce(string_agg(name, ',' order by place), '') as graph_entities, any_value(text) || coalesce(' ' || string_agg(name, ' ' order by place), '') as expanded from asks left join t on t.query_id = item_id group by item_id""")

twin("chunk_table_function", ORACLE["chunk_recursive"])
