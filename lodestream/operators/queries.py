"""Query rewriting as column expressions: normalisation, expansion, decomposition, variants, intent."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import capitalise, script, spaced, split_words, word_tokens

# Function words of keyword search.
ENGLISH_STOP = tuple(
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might shall "
    "can not no nor so yet both either neither each few more most other some such than too very just this that these those it its as if into about above "
    "after before between during through while what which who whom when where why how all any because also only own same then there their they them we our "
    "you your he she him her my me i up out over under again further here once".split()
)
# Stop words of paraphrases.
PARAPHRASE_STOP = tuple(
    "a an the is are was were be been being have has had do does did will would could should may might can shall of in to for on at with by from up about "
    "into through during before after above below between out off over under again further then once and or but if that this these those not".split()
)
# Stop words of feedback terms.
FEEDBACK_STOP = tuple("a an the and or but in on at to for of with by from is it was are were been be have has had this that these those not no".split())
# Words that open a question.
QUESTION_WORDS = tuple("what how why when where who which is are do does can could".split())
# Contractions and what they stand for.
CONTRACTIONS = {
    "can't": "cannot",
    "won't": "will not",
    "don't": "do not",
    "doesn't": "does not",
    "didn't": "did not",
    "isn't": "is not",
    "aren't": "are not",
    "wasn't": "was not",
    "weren't": "were not",
    "haven't": "have not",
    "hasn't": "has not",
    "hadn't": "had not",
    "wouldn't": "would not",
    "couldn't": "could not",
    "shouldn't": "should not",
    "mustn't": "must not",
    "mightn't": "might not",
    "i'm": "i am",
    "i've": "i have",
    "i'll": "i will",
    "i'd": "i would",
    "you're": "you are",
    "you've": "you have",
    "you'll": "you will",
    "you'd": "you would",
    "he's": "he is",
    "she's": "she is",
    "it's": "it is",
    "we're": "we are",
    "we've": "we have",
    "we'll": "we will",
    "we'd": "we would",
    "they're": "they are",
    "they've": "they have",
    "they'll": "they will",
    "they'd": "they would",
    "that's": "that is",
    "there's": "there is",
    "what's": "what is",
    "who's": "who is",
    "where's": "where is",
    "how's": "how is",
    "let's": "let us",
}
# Where a complex query is cut.
CUTS = r"(?i)\band\b|\bor\b|\bbut\b|\bvs\.?\b|\bversus\b|\bcompared?\s+(?:to|with)\b|;"
# Intents in order of priority, with their patterns and labels.
INTENTS = (
    ("definitional", ((r"\b(define|definition of|what (is|are|does)\b.{0,20}\bmean)\b", "definition trigger"), (r"\bmeaning of\b", "meaning-of"), (r"\bexplain (the )?(concept|term|doctrine|principle)\b", "explain-concept"), (r"\bwhat is (a |an |the )?\w+\??$", "what-is short"))),
    ("procedural", ((r"\bhow (do|does|can|should|to)\b", "how-to"), (r"\bprocedure (for|to|of)\b", "procedure-for"), (r"\bsteps? (to|for|in)\b", "steps-to"), (r"\bprocess (of|for|to)\b", "process-of"), (r"\bfile (a|an|the)\b", "file-a"), (r"\bapply (for|to)\b", "apply-for"))),
    ("comparative", ((r"\b(difference|distinguish|compare|contrast)\b", "compare-trigger"), (r"\bvs\.?\b|\bversus\b", "vs"), (r"\b(similar(ity)?|dissimilar(ity)?)\b", "similarity"), (r"\bwhat.{0,30}(differ|distinction)\b", "what-differs"))),
    ("multi_hop", ((r"\b(all|every|list (of|all))\b.*\b(cases?|statutes?|rulings?|judgments?)\b", "list-all"), (r"\blandmark\b", "landmark"), (r"\bsince \d{4}\b|\bafter \d{4}\b|\bbefore \d{4}\b", "temporal range"), (r"\band.{1,30}and\b", "multi-and conjunctions"), (r"\bmultiple\b.{0,20}\b(courts?|jurisdictions?|statutes?)\b", "multi-source"))),
    ("factual", ((r"\bwhat (is|are|was|were)\b", "what-is/was"), (r"\bwho (is|was|can|must|shall)\b", "who-is"), (r"\bwhen (is|was|does|did|can|must)\b", "when"), (r"\bwhere (is|are|can|must)\b", "where"), (r"\b(penalty|punishment|sentence|fine) (for|of|under)\b", "penalty-for"), (r"\bmaximum|minimum\b.{0,20}\b(term|sentence|fine|penalty)\b", "max/min sentence"))),
)
STRATEGIES = {"factual": "hyde", "definitional": "hyde", "procedural": "step_back", "comparative": "multi_query", "multi_hop": "composite[multi_query+step_back]", "unknown": "multi_query"}


@dataclass(frozen=True)
class Normalizer:
    """Settings of query normalisation. punctuation: remove, space or keep. extra_steps: functions of an array column."""

    lowercase: bool = True
    nfc: bool = True
    contractions: bool = True
    punctuation: str = "space"
    collapse: bool = True
    stop: Sequence[str] = ()
    min_token: int = 0
    max_tokens: int = 0
    min_query: int = 2
    quoted: bool = True
    extra_steps: Sequence = field(default_factory=tuple)


DEFAULT = Normalizer()
KEYWORD = Normalizer(stop=ENGLISH_STOP, min_token=2)
STRICT = Normalizer(stop=ENGLISH_STOP, min_token=2, max_tokens=32)


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC: Spark has no built-in for it."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def expand_contractions(text: Column) -> Column:
    for k in sorted(CONTRACTIONS, key=lambda x: (-len(x), x)):
        text = F.regexp_replace(text, rf"(?iU)\b{k}\b", CONTRACTIONS[k])
    return text


def normalised(queries: DataFrame, cfg: Normalizer = DEFAULT, query: str = "query") -> DataFrame:
    """queries with normalized, tokens, removed_stopwords, truncated, too_short and script. Phrases in double quotes stay one token."""
    q = queries.withColumn("script", script(F.col(query))).withColumn("_q", nfc(F.col(query)) if cfg.nfc else F.col(query))
    if cfg.quoted:
        q = q.withColumn("_p", F.transform(F.regexp_extract_all("_q", F.lit('"([^"]*)"'), F.lit(1)), lambda s: F.trim(s)))
        pieces = F.split("_q", '"[^"]*"')
        q = q.withColumn("_q", F.array_join(F.transform(pieces, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(" __quoted_"), (i - 1).cast("string"), F.lit("__ "), x))), ""))
    t = F.col("_q")
    t = F.lower(t) if cfg.lowercase else t
    t = expand_contractions(t) if cfg.contractions else t
    if cfg.punctuation != "keep":
        t = F.regexp_replace(t, "(?U)[^\\w\\s]", "" if cfg.punctuation == "remove" else " ")
    q = q.withColumn("_t", split_words(spaced(t) if cfg.collapse else t))
    if cfg.quoted:
        number = lambda w: F.regexp_extract(w, r"^__quoted_(\d+)__$", 1)
        q = q.withColumn("_t", F.transform("_t", lambda w: F.when(number(w) != "", F.get("_p", F.nullif(number(w), F.lit("")).cast("int"))).otherwise(w)))
    stop = (lambda w: ~F.contains(w, F.lit(" ")) & w.isin(*cfg.stop)) if cfg.stop else (lambda w: F.lit(False))
    q = q.withColumn("removed_stopwords", F.filter("_t", stop)).withColumn("_t", F.filter("_t", lambda w: ~stop(w)))
    if cfg.min_token > 1:
        q = q.withColumn("_t", F.filter("_t", lambda w: F.length(w) >= cfg.min_token))
    for step in cfg.extra_steps:
        q = q.withColumn("_t", step(F.col("_t")))
    q = q.withColumn("truncated", (F.size("_t") > cfg.max_tokens) & F.lit(cfg.max_tokens > 0))
    q = q.withColumn("tokens", F.slice("_t", 1, cfg.max_tokens) if cfg.max_tokens else F.col("_t")).withColumn("normalized", F.array_join("tokens", " "))
    return q.withColumn("too_short", F.length("normalized") < cfg.min_query).drop("_q", "_p", "_t")


def contains_phrase(text: Column, phrase: str) -> Column:
    """Whole-word test; a border that is no word character is taken literally."""
    word = lambda c: c.isalnum() or c == "_"
    import re

    return text.rlike(("(?U)" + (r"\b" if word(phrase[0]) else "") + re.escape(phrase) + (r"\b" if word(phrase[-1]) else ""))) if phrase else F.lit(False)


def with_synonyms(queries: DataFrame, synonyms: Mapping[str, Sequence[str]], limit: int = 3, query: str = "query") -> DataFrame:
    """added and expanded: up to `limit` synonyms of every token that the query does not hold yet, in order, each once."""
    low = F.lower(query)
    keys = F.transform(split_words(low), lambda w: F.regexp_replace(w, r"(?U)[^\w]", ""))
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k.lower()), F.array(*[F.lit(s) for s in list(v)[:limit]]))]) if synonyms else F.create_map().cast("map<string,array<string>>")
    names = sorted({s for v in synonyms.values() for s in list(v)[:limit]})
    held = F.array_compact(F.array(*[F.when(contains_phrase(low, s.lower()), F.lit(s.lower())) for s in names])) if names else F.array().cast("array<string>")
    found = F.flatten(F.transform(keys, lambda k: F.coalesce(F.try_element_at(table, k), F.array().cast("array<string>"))))
    fresh = F.filter(found, lambda s: ~F.array_contains(held, F.lower(s)))
    first = F.filter(fresh, lambda s, i: F.array_position(F.transform(fresh, lambda s: F.lower(s)), F.lower(s)) == i + 1)
    q = queries.withColumn("added", first)
    return q.withColumn("expanded", F.when(F.size("added") > 0, F.concat(F.col(query), F.lit(" "), F.array_join("added", " "))).otherwise(F.col(query)))


def decomposed(query: Column, min_length: int = 5) -> Column:
    parts = F.filter(F.transform(F.split(query, CUTS), lambda s: F.trim(s)), lambda p: F.length(p) >= min_length)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(query))


def variants(query: Column, limit: int = 3) -> Column:
    """The query, its key words, these in reverse order, and it without its question mark; each once, at most limit + 1."""
    words = split_words(query)
    key = F.filter(words, lambda w: ~F.btrim(F.lower(w), F.lit("?.,!")).isin(*QUESTION_WORDS))
    bare = F.trim(F.regexp_replace(F.rtrim(query), r"[? ]+$", ""))
    made = F.array_compact(
        F.array(
            F.trim(query),
            F.when(F.size(key) >= 2, F.array_join(key, " ")),
            F.when((F.size(words) >= 3) & (F.size(key) > 0), F.array_join(F.reverse(key), " ")),
            F.when(F.rtrim(query).endswith("?") & (bare != query), bare),
        )
    )
    low = F.transform(made, lambda s: F.lower(s))
    return F.slice(F.filter(made, lambda v, i: F.array_position(low, F.lower(v)) == i + 1), 1, limit + 1)


def _stem(query: Column) -> Column:
    return F.regexp_replace(F.trim(query), r"\?+$", "")


def paraphrases(query: Column, n: int = 3) -> Column:
    words = word_tokens(query)
    key = F.filter(words, lambda w: ~w.isin(*PARAPHRASE_STOP) & (F.length(w) > 2))
    q = _stem(query)
    about = F.lit(None).cast("string")
    for p in reversed(("what is", "what are", "how does", "how do", "explain", "describe")):
        about = F.when(F.lower(q).startswith(p), F.concat(F.lit("information about "), F.trim(F.substr(q, F.lit(len(p) + 1))))).otherwise(about)
    made = F.array_compact(F.array(F.when((F.size(key) > 0) & (key != words), F.array_join(key, " ")), about, F.when(F.size(split_words(query)) <= 4, F.concat(F.lit("definition of "), F.regexp_replace(F.lower(query), r"\?+$", "")))))
    return F.slice(F.filter(made, lambda v: (F.trim(v) != "") & (F.lower(v) != F.lower(query))), 1, n)


def step_back(query: Column) -> Column:
    """Cut before the first connector, in this order; else, of more than three words, the first goes."""
    q = _stem(query)
    words = split_words(q)
    out = F.when(F.size(words) > 3, F.array_join(F.slice(words, F.lit(2), F.size(words)), " ")).otherwise(q)
    for c in reversed((" in ", " for ", " using ", " with ", " of ", " about ")):
        at = F.instr(F.lower(q), c)
        head = F.trim(F.substr(q, F.lit(1), at - 1))
        out = F.when((at > 0) & (head != ""), head).otherwise(out)
    return out


def hypothesis(query: Column) -> Column:
    """A sentence that might answer the query."""
    q = _stem(query)
    out = F.concat(F.lit("The answer to '"), q, F.lit("' involves relevant information about the topic."))
    for p, kind in (("how do", 1), ("how does", 1), ("what are", 0), ("what is", 0)):
        rest = F.trim(F.substr(q, F.lit(len(p) + 1)))
        made = F.concat(capitalise(rest), F.lit(" works by performing the relevant operations.")) if kind else F.concat(capitalise(rest), F.lit(" is a concept related to "), F.lower(rest), F.lit("."))
        out = F.when(F.lower(q).startswith(p), made).otherwise(out)
    return out


def classified(queries: DataFrame, query: str = "query") -> DataFrame:
    """intent, confidence, matched and strategy: the first family with a match wins; two matches make it strong."""
    q = F.lower(F.trim(query))
    intent, matched = F.lit("unknown"), F.array().cast("array<string>")
    for name, patterns in reversed(INTENTS):
        hits = F.array_compact(F.array(*[F.when(q.rlike("(?U)" + p), F.lit(label)) for p, label in patterns]))
        intent, matched = F.when(F.size(hits) > 0, F.lit(name)).otherwise(intent), F.when(F.size(hits) > 0, hits).otherwise(matched)
    out = queries.withColumn("matched", matched).withColumn("intent", intent)
    out = out.withColumn("confidence", F.when(F.size("matched") >= 2, 0.9).when(F.size("matched") == 1, 0.6).otherwise(0.0))
    names = F.create_map(*[x for k, v in STRATEGIES.items() for x in (F.lit(k), F.lit(v))])
    return out.withColumn("strategy", F.element_at(names, F.col("intent")))


def feedback_terms(ranked: DataFrame, queries: DataFrame, terms: int = 5, content: str = "content") -> DataFrame:
    """Pseudo-relevance feedback: (query_id, query, added, expanded) with the commonest new words of the results given, ties by first
    occurrence (rank, then place)."""
    words = ranked.select("query_id", "rank", F.posexplode(word_tokens(F.col(content))).alias("place", "term")).where((F.length("term") > 2) & ~F.col("term").isin(*FEEDBACK_STOP))
    known = queries.select("query_id", F.explode(split_words(F.lower("query"))).alias("term")).distinct()
    n = words.join(known, ["query_id", "term"], "left_anti").groupBy("query_id", "term").agg(F.count("*").alias("n"), F.min(F.struct("rank", "place")).alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), "first")
    top = n.withColumn("r", F.row_number().over(w)).where(F.col("r") <= terms)
    added = top.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("added"))
    q = queries.join(added, "query_id", "left").withColumn("added", F.coalesce("added", F.array().cast("array<string>")))
    return q.withColumn("expanded", F.when(F.size("added") > 0, F.concat("query", F.lit(" "), F.array_join("added", " "))).otherwise(F.col("query")))
