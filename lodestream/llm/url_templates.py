"""URL filter by a path-template tree, in DataFrame functions only.

Listed rules come first: a rule names a host (with all its subdomains) and the beginning of a path; the longest that fits decides. The
urls that rules decide are the labels for the rest:

1. Segments that are variable by their look (digits, long hexadecimal) become wildcards in place, and urls are counted by host and
   shaped path, so a host with a third of all urls is one row per shaped path from there on.
2. Level by level, a node of the tree whose children are many and rarely repeat has them generalised into one wildcard.
3. Branches of a host (first segments) are held against the pool of all its branches with the same commonest rest template. A branch
   joins the pool if its rest paths are distributed over templates like the pool's (total variation, with room for small samples), and
   its labels do not differ from the pool's by more than chance; branches that differ to the same side are merged, branches with few
   labels are pooled apart from the labelled ones.
4. A template's purity is its share of allowed labels, smoothed towards its merged branch, that towards the host, and that towards all
   urls. Templates below `reject` are blocked.

Defined results: a null url or one without `://` has empty host and path, fits no rule and is judged as the template of the empty
host. Repeated rows are judged alike; null ids are kept; urls are taken whole; other columns play no part. An empty table gives an
empty result. Without labels nothing is blocked (the prior is allowed).
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

# (verdict, host, beginning of the path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
LEVELS = 32  # a tree is as deep as its deepest path, up to here; deeper segments are one wildcard


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, ascii_uppercase, ascii_lowercase), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def shaped(path: Column) -> Column:
    """The path with what is variable by its look as wildcards."""
    hexed = F.regexp_replace(path, r"(?<=^|[/._-])(?=[0-9a-f]*[0-9])[0-9a-f]{8,}(?=$|[/._-])", "*")
    return F.regexp_replace(hexed, r"[0-9]+", "*")


def url_templates(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    many: int = 10,
    rarely: float = 0.3,
    differ: float = 0.3,
    chance: float = 3.0,
    min_labels: int = 5,
    strength: float = 10.0,
    reject: float = 0.25,
) -> DataFrame:
    """id_col, host, path, rule, verdict, template, purity."""
    host, path = host_and_path(F.col(url_col))
    base = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", name).withColumn("by_rule", verdict).withColumn("shape", shaped(F.col("path")))

    good, bad = F.count_if(F.col("by_rule") == "allow"), F.count_if(F.col("by_rule") == "block")
    # every level reads the one before several times: written down, plans stay small
    leaves = checkpoint(base.groupBy("host", "shape").agg(F.count("*").alias("n"), good.alias("good"), bad.alias("bad")))
    parts = F.split("shape", "/")
    tree = leaves.withColumn("segs", F.when(F.size(parts) > LEVELS + 1, F.concat(F.slice(parts, 1, LEVELS), F.array(F.lit("**")))).otherwise(parts)).withColumn("prefix", F.lit(""))
    deepest = leaves.agg(F.max(F.size(parts))).collect()[0][0] or 1  # one row
    for level in range(1, min(deepest - 1, LEVELS) + 1):
        seg = F.get("segs", F.lit(level))
        child = tree.where(seg.isNotNull()).groupBy("host", "prefix", seg.alias("seg")).agg(F.sum("n").alias("n"))
        wild = child.groupBy("host", "prefix").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).where((F.col("kinds") >= many) & (F.col("kinds") >= rarely * F.col("all"))).select("host", "prefix", F.lit(True).alias("wild"))
        tree = checkpoint(tree.join(wild, ["host", "prefix"], "left").withColumn("prefix", F.when(seg.isNull(), F.col("prefix")).otherwise(F.concat("prefix", F.lit("/"), F.when(F.col("wild"), "*").otherwise(seg)))).drop("wild"))

    tree = tree.withColumn("branch", F.split_part(F.col("prefix"), F.lit("/"), F.lit(2))).withColumn("rest", F.expr("substring(prefix, length(branch) + 2)")).select("host", "shape", "n", "good", "bad", "prefix", "branch", "rest")

    # branches against the pool of their host's branches with the same commonest template
    rests = checkpoint(tree.groupBy("host", "branch", "rest").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    usual = F.max_by("rest", F.struct("n", "rest")).alias("usual")
    totals = checkpoint(rests.groupBy("host", "branch").agg(F.sum("n").alias("all"), F.sum("good").alias("good"), F.sum("bad").alias("bad"), usual))
    labels = F.col("good") + F.col("bad")
    known = (labels >= min_labels).alias("known")
    mine = rests.select("host", "branch", "rest", "n").join(totals.select("host", "branch", "all", "usual", known), ["host", "branch"])
    pool = ["host", "usual", "known"]
    pooled = mine.groupBy(*pool, "rest").agg(F.sum("n").alias("pool_n"))
    sizes = totals.groupBy("host", "usual", known).agg(F.sum("all").alias("pool_all"))
    p, q = F.col("n") / F.col("all"), F.col("pool_n") / F.col("pool_all")
    apart = mine.join(pooled, [*pool, "rest"]).join(sizes, pool).groupBy("host", "branch").agg((0.5 * (F.sum(F.abs(p - q)) + 1 - F.sum(q))).alias("apart"))
    near = totals.join(apart, ["host", "branch"]).withColumn("known", labels >= min_labels).withColumn("alike", F.col("apart") <= differ + 1 / F.sqrt("all"))
    rate = near.where("alike").groupBy(*pool).agg(((F.sum("good") + 1) / (F.sum("good") + F.sum("bad") + 2)).alias("rate"))
    near = near.join(rate, pool, "left")
    error = (F.col("good") / labels - F.col("rate")) / F.sqrt(F.col("rate") * (1 - F.col("rate")) / labels)
    side = F.when(~F.col("known"), "few").when(error > chance, "above").when(error < -chance, "below").otherwise("like")
    kind = F.when(F.col("alike"), F.xxhash64(F.lit("pool"), "usual", side)).otherwise(F.xxhash64(F.lit("alone"), "branch"))
    merged = near.select("host", "branch", kind.alias("kind"))

    of_all = leaves.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()[0]  # one row
    prior = ((of_all["good"] or 0) + 1) / ((of_all["good"] or 0) + (of_all["bad"] or 0) + 1)
    smooth = lambda up: (F.col("good") + strength * up) / (labels + strength)
    sums = (F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    per_host = leaves.groupBy("host").agg(*sums).select("host", smooth(F.lit(prior)).alias("host_purity"))
    tree = checkpoint(tree.join(merged, ["host", "branch"]))
    per_kind = tree.groupBy("host", "kind").agg(*sums).join(per_host, "host").select("host", "kind", smooth(F.col("host_purity")).alias("kind_purity"))
    per_template = tree.groupBy("host", "kind", "rest").agg(*sums).join(per_kind, ["host", "kind"]).select("host", "kind", "rest", smooth(F.col("kind_purity")).alias("purity"))
    judged = checkpoint(tree.join(per_template, ["host", "kind", "rest"]).select("host", "shape", F.col("prefix").alias("template"), "purity"))
    out = base.join(judged, ["host", "shape"])
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("purity") < reject, "block").otherwise("allow")).alias("verdict"), "template", F.round("purity", 9).alias("purity"))
