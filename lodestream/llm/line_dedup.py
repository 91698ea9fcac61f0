"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is its words; blank lines are never removed. Two lines match when their words are equal or, if both have `min_words` or more,
when one inserted, deleted or replaced word turns one into the other. A line is removed when an earlier line (by document id, then
position) of the whole corpus matches it, whether or not that one is removed itself; the earliest of each kind stays.

1. Equal lines: one class per word sequence (128-bit hash), with its first place. Minima are combined before the shuffle.
2. Pigeonhole: one edit leaves a line's first or its last half as it is. Only classes that share a half with another class go on, and
   only with variants whose edit lies in the other half.
3. Deletion neighbourhood: every remaining class emits its one-word deletions as hashed keys, with the place of the deletion for a
   replacement, without it for an insertion (which meets the shorter line's own key). Members of a key all match each other's
   earliest, so a key needs its minimum and no pairs.
4. The match of each class with its earliest witness is verified word by word on the lines themselves.

Defined results: ids are integers. Null text counts as empty and stays null; rows with a null id are returned unchanged and match
nothing. Rows that repeat an id with another text are documents of their own, in the order of a hash of their texts; rows that repeat
id and text are one document, and all of them lose the same lines. Lines are whole, however long. Other columns, of any name, are kept.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, place_number, text_place

APPENDED = 4096  # words of a line whose keys are put together one by one: copying so few costs less than the passes
_BREAK = r"[\x20\x09-\x0D]+"


def words(line: Column) -> Column:
    """The words of a line: white space goes from both ends first, so that the split leaves no empty words to filter."""
    solid = F.btrim(line, F.lit(" \t\n\x0b\f\r"))
    return F.when(solid == "", F.array().cast("array<string>")).otherwise(F.split(solid, _BREAK))


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def deletions(w: Column) -> Column:
    """64-bit keys of the sequence w without its i-th word, for every i. Words are hashed with their place and combined by XOR, so
    each key follows from the one before: word i - 1 comes back to its own place, word i goes."""
    own = F.transform(w, lambda x, i: F.xxhash64(x, i))
    moved = F.transform(w, lambda x, i: F.xxhash64(x, i - 1))
    first = F.aggregate(F.slice(moved, 2, F.greatest(F.size(w) - 1, F.lit(0))), F.lit(0).cast("long"), _xor)
    steps = F.zip_with(F.slice(own, 1, F.size(w) - 1), F.slice(moved, 2, F.size(w) - 1), _xor)
    short = F.aggregate(steps, F.array(first), lambda acc, s: F.array_append(acc, _xor(F.element_at(acc, -1), s)))
    return F.when(F.size(w) <= APPENDED, short).otherwise(running_xor(F.concat(F.array(first), steps)))


def running_xor(x: Column) -> Column:
    """The XOR of x[0], ..., x[i] for every i, by doubling: every pass reaches twice as far back, so a line costs its length times the
    logarithm of its length."""
    reach = F.filter(F.array(*[F.lit(1 << i) for i in range(31)]), lambda s: s < F.size(x))
    return F.aggregate(reach, x, lambda acc, s: F.transform(acc, lambda v, i: F.when(i >= s, _xor(v, F.get(acc, i - s))).otherwise(v)))


def whole_key(w: Column) -> Column:
    return F.aggregate(F.transform(w, lambda x, i: F.xxhash64(x, i)), F.lit(0).cast("long"), _xor)


def line_table(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(doc, pos, n, h1, h2, p0, s0, p1, s1) of every line with a word. pos: the text's place plus the number of the line. The last four
    hash a half of the line, for matches of its own length or one more (0) and of one less (1)."""
    src = source(docs, id_col, text_col).select("doc", "at", F.posexplode(F.split("text", "\n")).alias("number", "line"))
    t = src.select("doc", (F.col("at") + F.col("number")).alias("pos"), words(F.col("line")).alias("w")).where(F.size("w") > 0).withColumn("n", F.size("w"))
    half = {0: F.expr("n div 2").cast("int"), 1: F.expr("(n - 1) div 2").cast("int")}
    long_enough = F.col("n") >= min_words
    keys = []
    for less, h in half.items():
        m = F.col("n") - less
        keys.append(F.when(long_enough, F.xxhash64(F.lit(0), m, F.slice("w", F.lit(1), h))).alias(f"p{less}"))
        keys.append(F.when(long_enough, F.xxhash64(F.lit(1), m, F.slice("w", F.col("n") - (m - h) + 1, m - h))).alias(f"s{less}"))
    return t.select("doc", "pos", "n", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit("second"), "w").alias("h2"), *keys)


def source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, at, text) of the rows that have an id and a text."""
    there = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return there.select(F.col(id_col).cast("long").alias("doc"), text_place(F.col(text_col)).alias("at"), F.col(text_col).alias("text"))


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8) -> tuple[DataFrame, DataFrame]:
    """(removed, documents). removed: one row per distinct id and text that loses lines: doc, removed (sorted line numbers from 0).
    documents: the rows of docs with what is left of each text."""
    lines = checkpoint(line_table(docs, id_col, text_col, min_words))  # texts are cut into words once
    halves = ("p0", "s0", "p1", "s1")
    classes = checkpoint(lines.groupBy("h1", "h2").agg(F.min(F.struct("doc", "pos")).alias("at"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in halves)))

    # classes that share a half with another class
    long_lines = classes.where(F.col("n") >= min_words)
    half = long_lines.select("at", F.posexplode(F.array(*halves)).alias("kind", "key"))
    twice = half.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    kinds = half.join(twice, "key", "left_semi").groupBy("at").agg(F.bit_or(F.expr("shiftleft(1, kind)")).alias("kinds"))
    text_at = (F.col("at.pos") - place_number(F.col("at.pos"))).alias("at")
    wanted = kinds.groupBy(F.col("at.doc").alias("doc"), text_at).agg(F.collect_list(F.struct(F.col("at.pos").alias("pos"), "kinds")).alias("want"))
    found = source(docs, id_col, text_col).join(wanted, ["doc", "at"]).select("doc", F.split("text", "\n").alias("lines"), F.explode("want").alias("want"))
    line = F.get("lines", place_number(F.col("want.pos")))
    found = found.where(line.isNotNull()).select("doc", F.col("want.pos").alias("pos"), F.col("want.kinds").alias("kinds"), words(line).alias("w"))
    found = checkpoint(found.dropDuplicates(["doc", "pos"]))

    # their deletion neighbourhoods
    # place 0 stands for the whole line, place i for the line without its word i - 1
    variants = F.concat(F.array(whole_key(F.col("w"))), deletions(F.col("w")))
    each = found.select("doc", "pos", "kinds", F.size("w").alias("n"), F.posexplode(variants).alias("place", "v")).withColumn("i", F.col("place") - 1)
    h0, h1 = F.expr("n div 2"), F.expr("(n - 1) div 2")
    has = lambda bit: F.col("kinds").bitwiseAND(F.lit(1 << bit)) != 0
    swapped = (F.col("i") >= 0) & ((has(0) & (F.col("i") >= h0)) | (has(1) & (F.col("i") < h0)))
    longer = (F.col("i") >= 0) & ((has(2) & (F.col("i") >= h1)) | (has(3) & (F.col("i") <= h1)))
    shorter = (F.col("i") < 0) & (has(0) | has(1))
    # replacements: the earliest of a key; insertions: the earliest whole line of a key for its longer lines, and the other way round
    swap = F.struct(F.lit(0).alias("side"), F.when(swapped, F.xxhash64(F.lit("swap"), "n", "i", "v")).alias("key"))
    cut = F.struct(
        F.when(longer, F.lit(1)).otherwise(F.lit(2)).alias("side"),
        F.when(longer | shorter, F.xxhash64(F.lit("cut"), F.when(longer, F.col("n") - 1).otherwise(F.col("n")), "v")).alias("key"),
    )
    rows = checkpoint(each.select("doc", "pos", F.inline(F.array(swap, cut))).where("key is not null"))
    at = F.struct("doc", "pos")
    mins = rows.groupBy("key").agg(F.min(F.when(F.col("side") == 0, at)).alias("m0"), F.min(F.when(F.col("side") == 1, at)).alias("m1"), F.min(F.when(F.col("side") == 2, at)).alias("m2"), F.count("*").alias("c")).where("c > 1")
    met = rows.join(mins, "key").withColumn("other", F.when(F.col("side") == 0, F.col("m0")).when(F.col("side") == 1, F.col("m2")).otherwise(F.col("m1")))
    near = met.where(F.col("other") < at).groupBy("doc", "pos").agg(F.min("other").alias("other"))

    # verify on the lines
    x = found.select("doc", "pos", F.col("w").alias("x"))
    y = found.select(F.struct("doc", "pos").alias("other"), F.col("w").alias("y"))
    near = checkpoint(near.join(x, ["doc", "pos"]).join(y, "other").where(one_edit(F.col("x"), F.col("y"))).select("doc", "pos"))

    # every place of an equal line but the first, and the first places of classes that match an earlier one
    firsts = classes.select("h1", "h2", "at").join(near.select(F.struct("doc", "pos").alias("at"), F.lit(True).alias("gone")), "at", "left")
    gone = lines.select("doc", "pos", "h1", "h2").join(firsts, ["h1", "h2"]).where(F.col("gone") | (F.struct("doc", "pos") != F.col("at"))).select("doc", "pos")
    number = place_number(F.col("pos"))
    removed = gone.groupBy("doc", (F.col("pos") - number).alias("at")).agg(F.array_sort(F.collect_set(number)).alias("removed"))

    free = "_" + "_".join(docs.columns)  # a name that no column of docs has
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda line, i: ~F.array_contains(F.col("removed" + free), i)), "\n")
    mine = removed.toDF("doc" + free, "at" + free, "removed" + free)
    out = docs.join(mine, (docs[id_col].cast("long") == F.col("doc" + free)) & (text_place(docs[text_col]) == F.col("at" + free)), "left")
    out = out.withColumn(text_col, F.when(F.col("removed" + free).isNull(), F.col(text_col)).otherwise(kept))
    return removed.select("doc", "removed"), out.select(docs.columns)


def one_edit(x: Column, y: Column) -> Column:
    """Whether one word replaced, inserted or deleted turns the array x into y: what is left between their common ends is one word on
    the longer side and at most one on the other."""
    n = F.least(F.size(x), F.size(y))
    off = F.array_position(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda a, b: a != b), True)  # first difference, from 1
    head = F.when(off == 0, n).otherwise(off.cast("int") - 1)
    rest = lambda a, b: F.slice(a, head + 1 + b, F.greatest(F.size(a) - head - b, F.lit(0)))
    return (
        F.when(F.size(x) == F.size(y), rest(x, 1) == rest(y, 1))
        .when(F.size(x) == F.size(y) + 1, rest(x, 1) == rest(y, 0))
        .when(F.size(x) + 1 == F.size(y), rest(x, 0) == rest(y, 1))
        .otherwise(False)
    )
