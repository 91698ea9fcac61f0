"""A knowledge graph that grows by batches: mentions, statements and aliases as tables, entities and relations as views of them.

A batch of documents writes its mentions and statements to folders of its own; writing it again, as a stream does after a failure,
overwrites them. A document counts in its latest batch, so it can be indexed anew. Entities and relations are sums over these tables:
batches in any split give the graph of one batch. A common entity is many rows of mentions, never one long list of documents.

Names compare in lower case without blanks around. A name is looked up among the entities first, then among the aliases; aliases of
aliases are followed, and of several entities that a group of aliases reaches the smallest key answers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .graph import TERMS, mentions, stated_relations
from .tables import table_of


def norm(name: str):  # noqa: ANN201
    return F.lower(F.trim(name))


def closed(aliases: DataFrame) -> DataFrame:
    """(name, root) over (alias, name): the smallest name that aliases connect each with. Every round halves the way to it."""
    pairs = aliases.select(norm("alias").alias("u"), norm("name").alias("v")).where("u <> v and u <> '' and v <> ''")
    edges = table_of(pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    roots = table_of(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("name"), F.least("u", "m").alias("root")))
    while True:
        near = edges.join(roots.withColumnRenamed("name", "v"), "v").groupBy(F.col("u").alias("name")).agg(F.min("root").alias("m"))
        step = roots.join(near, "name").select("name", F.least("root", "m").alias("r"), F.col("root").alias("old"))
        jump = roots.select(F.col("name").alias("r"), F.col("root").alias("jump"))
        new = table_of(step.join(jump, "r", "left").select("name", F.least("r", F.coalesce("jump", "r")).alias("root"), "old"))
        roots = new.select("name", "root")
        if new.where("root <> old").isEmpty():
            return roots


@dataclass(frozen=True)
class GraphIndex:
    spark: SparkSession
    path: str
    terms: tuple[str, ...] = TERMS
    concepts: bool = False

    def index(self, docs: DataFrame, batch: int) -> None:
        """Mentions and statements of a batch of documents (doc_id, text)."""
        docs.select("doc_id").distinct().write.mode("overwrite").parquet(f"{self.path}/documents/batch={batch}")
        mentions(docs, self.terms, self.concepts).write.mode("overwrite").parquet(f"{self.path}/mentions/batch={batch}")
        found = self.spark.read.parquet(f"{self.path}/mentions/batch={batch}")
        stated_relations(docs, found).write.mode("overwrite").parquet(f"{self.path}/statements/batch={batch}")

    def index_stream(self, docs: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """The same for every micro-batch of a stream."""
        own = (self.path, self.terms, self.concepts)

        def one(batch: DataFrame, batch_id: int) -> None:
            GraphIndex(batch.sparkSession, *own).index(batch, batch_id)

        return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def add_aliases(self, aliases: DataFrame, batch: int) -> None:
        """(alias, name) pairs."""
        aliases.select("alias", "name").write.mode("overwrite").parquet(f"{self.path}/aliases/batch={batch}")

    def _latest(self, what: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/{what}")
        last = self.spark.read.parquet(f"{self.path}/documents").groupBy("doc_id").agg(F.max("batch").alias("batch"))
        return rows.join(last, ["doc_id", "batch"], "left_semi").drop("batch")

    def mentions(self) -> DataFrame:
        """(doc_id, key, name, type), a row a document and entity."""
        return self._latest("mentions")

    def entities(self) -> DataFrame:
        """(key, name, type, documents): name and type of the smallest document."""
        first = F.struct("doc_id", "name", "type")
        t = self.mentions().groupBy("key").agg(F.min(first).alias("x"), F.count("*").alias("documents"))
        return t.select("key", "x.name", "x.type", "documents")

    def relations(self) -> DataFrame:
        """(subject, predicate, obj, weight, documents)."""
        each = self._latest("statements").groupBy("subject", "predicate", "obj", "doc_id").agg(F.sum("weight").alias("weight"))
        return each.groupBy("subject", "predicate", "obj").agg(F.sum("weight").alias("weight"), F.count("*").alias("documents"))

    def aliases(self) -> DataFrame:
        """(alias, key) of every alias that leads to an entity and is none itself."""
        roots = table_of(closed(self.spark.read.parquet(f"{self.path}/aliases")))
        known = self.entities().select(F.col("key").alias("name"))
        best = roots.join(known, "name", "left_semi").groupBy("root").agg(F.min("name").alias("key"))
        return roots.join(known, "name", "left_anti").join(best, "root").select(F.col("name").alias("alias"), "key")

    def lookup(self, names: DataFrame) -> DataFrame:
        """(asked, key, name, type, documents) of names (name): by the entity's own name, else by alias; others give no row."""
        asked = names.select(F.col("name").alias("asked"), norm("name").alias("key")).distinct()
        ent = table_of(self.entities())
        direct = asked.join(ent, "key")
        other = asked.join(ent, "key", "left_anti").withColumnRenamed("key", "alias").join(self.aliases(), "alias").join(ent, "key")
        return direct.unionByName(other.drop("alias")).select("asked", "key", "name", "type", "documents")
