"""A knowledge graph as two tables: entities (name, type, doc_ids, aliases) and relations (subject, predicate, obj, weight, doc_ids).
Names compare in lower case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Technology terms.
TERMS = tuple(
    "faiss chromadb qdrant weaviate pinecone openai huggingface langchain llamaindex transformer bert gpt llm rag vector embedding retrieval attention "
    "encoder decoder tokeniser tokenizer pytorch tensorflow jax numpy scipy elasticsearch opensearch solr lucene bm25 tfidf cosine euclidean docker "
    "kubernetes fastapi flask django postgresql redis mongodb neo4j github git python rust golang".split()
)
# Patterns that state a relation.
RELATIONS = (
    (r"(\w+) is (?:a|an) (\w+)", "IS_A"), (r"(\w+) (?:is )?developed by (\w+)", "DEVELOPED_BY"), (r"(\w+) (?:is )?built on (\w+)", "BUILT_ON"), (r"(\w+) uses? (\w+)", "USES"),
    (r"(\w+) extends? (\w+)", "EXTENDS"), (r"(\w+) (?:is )?part of (\w+)", "PART_OF"), (r"(\w+) integrates? (?:with )?(\w+)", "INTEGRATES_WITH"), (r"(\w+) and (\w+) are (?:related|similar)", "RELATED_TO"),
)
CAPITALISED = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,4})\b"
MEASURE = r"(?i)\b(\d+(?:\.\d+)?\s*(?:dimensions?|layers?|heads?|tokens?|bytes?|ms|seconds?))\b"


def mentions(docs: DataFrame, terms: tuple[str, ...] = TERMS, concepts: bool = False) -> DataFrame:
    """(doc_id, key, name, type) of every mention: known terms, acronyms, with `concepts` capitalised terms, then measures; a key has the
    type of the first of these that finds it and the name of its first mention there."""
    t = F.col("text")
    passes = [
        ("TECHNOLOGY", F.filter(F.regexp_extract_all(t, F.lit(r"(?U)\b(\w+)\b"), F.lit(1)), lambda w: F.lower(w).isin(*terms))),
        ("ACRONYM", F.regexp_extract_all(t, F.lit(r"(?U)\b([A-Z]{2,8}s?)\b"), F.lit(1))),
        ("CONCEPT", F.regexp_extract_all(t, F.lit(CAPITALISED), F.lit(1)) if concepts else F.array().cast("array<string>")),
        ("MEASURE", F.regexp_extract_all(t, F.lit(MEASURE), F.lit(1))),
    ]

    def tagged(k: int, kind: str, names: Column) -> Column:
        return F.transform(names, lambda n, i: F.struct(F.lit(k).alias("pass"), i.alias("i"), n.alias("name"), F.lit(kind).alias("type")))

    all_ = F.concat(*[tagged(k, kind, a) for k, (kind, a) in enumerate(passes)])
    m = docs.where(t.isNotNull()).select("doc_id", F.explode(all_).alias("m")).select("doc_id", F.lower("m.name").alias("key"), "m")
    first = m.groupBy("doc_id", "key").agg(F.min_by("m", F.struct("m.pass", "m.i")).alias("m"))
    return first.select("doc_id", "key", "m.name", "m.type")


def entities(found: DataFrame) -> DataFrame:
    """Mentions merged by key: the name and type of the smallest document, all documents, sorted."""
    return found.groupBy("key").agg(F.min_by("name", "doc_id").alias("name"), F.min_by("type", "doc_id").alias("type"), F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))


def stated_relations(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, subject, predicate, obj, weight) from sentences: patterns between known entities (1.0), and every pair of entities in a
    sentence (0.5, smaller key first)."""
    s = docs.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", r"[.!?\n]+")).alias("sentence", "t"))
    known = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))  # the entities of one document
    s = s.join(known, "doc_id").withColumn("present", F.filter("keys", lambda k: F.contains(F.lower("t"), k))).where(F.size("present") >= 2)

    def pairs(pattern: str, name: str) -> Column:
        one, two = (F.regexp_extract_all("t", F.lit("(?iU)" + pattern), F.lit(g)) for g in (1, 2))
        return F.zip_with(one, two, lambda a, b: F.struct(F.lower(a).alias("subject"), F.lit(name).alias("predicate"), F.lower(b).alias("obj")))

    all_ = F.concat(*[pairs(p, name) for p, name in RELATIONS])
    stated = s.select("doc_id", "keys", F.explode(all_).alias("r")).select("doc_id", "keys", "r.*").where(F.array_contains("keys", F.col("subject")) & F.array_contains("keys", F.col("obj")))
    stated = stated.select("doc_id", "subject", "predicate", "obj", F.lit(1.0).alias("weight"))
    p = s.select("doc_id", "sentence", "present", F.explode("present").alias("subject"))
    near = p.select("doc_id", "subject", F.explode(F.filter("present", lambda k: k > F.col("subject"))).alias("obj"))
    return stated.union(near.select("doc_id", "subject", F.lit("CO_OCCURS_WITH").alias("predicate"), "obj", F.lit(0.5).alias("weight")))


def relations(stated: DataFrame) -> DataFrame:
    """Equal triples merged: weights add up, documents unite."""
    return stated.groupBy("subject", "predicate", "obj").agg(F.sum("weight").alias("weight"), F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))


def matching(rel: DataFrame, subject: str | None = None, predicate: str | None = None, obj: str | None = None) -> DataFrame:
    for c, v in (("subject", subject), ("predicate", predicate), ("obj", obj)):
        if v is not None:
            rel = rel.where(F.lower(c) == v.lower())
    return rel


def neighbours(rel: DataFrame, starts: DataFrame, max_hops: int = 1, direction: str = "both", predicate: str | None = None) -> DataFrame:
    """starts (start) with every entity within max_hops: (start, node, hops), the start excluded. Each hop is one join on the frontier."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"no such direction: {direction}")
    rel = matching(rel, predicate=predicate)
    out = rel.select(F.lower("subject").alias("u"), F.lower("obj").alias("v"))
    back = out.select(F.col("v").alias("u"), F.col("u").alias("v"))
    edges = {"out": out, "in": back, "both": out.union(back)}[direction].distinct()
    seen = starts.select(F.lower("start").alias("start")).distinct().withColumn("node", F.col("start")).withColumn("hops", F.lit(0))
    front = seen
    for hop in range(1, max_hops + 1):
        new = front.join(edges, F.col("node") == F.col("u")).select("start", F.col("v").alias("node")).distinct().join(seen, ["start", "node"], "left_anti").withColumn("hops", F.lit(hop))
        seen, front = seen.union(new), new
    return seen.where("hops > 0")


def subgraph(ent: DataFrame, rel: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = names.select(F.lower("name").alias("_n")).distinct()
    return ent.join(n, F.lower("key") == F.col("_n"), "left_semi"), rel.join(n, F.lower("subject") == F.col("_n"), "left_semi").join(n, F.lower("obj") == F.col("_n"), "left_semi")


def expanded_queries(queries: DataFrame, ent: DataFrame, rel: DataFrame, max_hops: int = 2, terms: int = 10) -> DataFrame:
    """(query_id, query, graph_entities, expanded): neighbours of the query's entities, nearest first, at most `terms`."""
    q = mentions(queries.select(F.col("query_id").alias("doc_id"), F.col("query").alias("text"))).select(F.col("doc_id").alias("query_id"), "key")
    q = q.join(ent.select("key"), "key", "left_semi")
    near = neighbours(rel, q.select(F.col("key").alias("start")), max_hops)
    hits = q.join(near, F.col("key") == F.col("start")).join(ent.select(F.col("key").alias("node"), "name"), "node").groupBy("query_id", "name").agg(F.min("hops").alias("hops"))
    w = Window.partitionBy("query_id").orderBy("hops", "name")
    top = hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= terms)
    names = top.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("graph_entities"))
    out = queries.join(names, "query_id", "left").withColumn("graph_entities", F.coalesce("graph_entities", F.array().cast("array<string>")))
    return out.withColumn("expanded", F.when(F.size("graph_entities") > 0, F.concat("query", F.lit(" "), F.array_join("graph_entities", " "))).otherwise(F.col("query")))


def entity(ent: DataFrame, names: DataFrame) -> DataFrame:
    """The entities of the names (name), in any case and with blanks around; names without an entity give no row."""
    wanted = names.select(F.lower(F.trim("name")).alias("_n")).distinct()
    return ent.join(wanted, F.col("key") == F.col("_n"), "left_semi")


def sizes(ent: DataFrame, rel: DataFrame) -> DataFrame:
    """One row: n_entities, n_relations."""
    e = ent.agg(F.count("*").alias("n_entities"))
    return e.join(F.broadcast(rel.agg(F.count("*").alias("n_relations"))))  # one row each


def save(ent: DataFrame, rel: DataFrame, path: str) -> None:
    """JSON lines of entities and relations under a path."""
    ent.write.mode("overwrite").json(f"{path}/entities")
    rel.write.mode("overwrite").json(f"{path}/relations")


def load(spark: SparkSession, path: str, id_type: str = "bigint") -> tuple[DataFrame, DataFrame]:
    """(entities, relations) as they were saved."""
    ent = spark.read.schema(f"key string, name string, type string, doc_ids array<{id_type}>").json(f"{path}/entities")
    rel = spark.read.schema(f"subject string, predicate string, obj string, weight double, doc_ids array<{id_type}>").json(f"{path}/relations")
    return ent, rel
