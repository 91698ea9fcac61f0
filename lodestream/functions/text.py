"""Text expressions: tokenisers, normal forms, shingles, sentences and set similarities as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the sparse retriever.
BM25_STOP = tuple(
    "a an the and or but in on at to for of with by from is it was are were been be have has had do does did will would could should may might "
    "shall can this that these those i you he she we they me him her us them my your his its our their not no nor so if as up out about".split()
)
# Stop words of keyword extraction (adaptive depth, compression, explanation).
KEYWORD_STOP = tuple(
    "a an the is are was were be been being have has had do does did will would could should may might can shall of in to for on at with by from "
    "and or but if that this it its not no as so".split()
)


def in_words(token: Column, words: tuple[str, ...]) -> Column:
    return token.isin(*words)


def spaced(text: Column) -> Column:
    """Runs of Unicode white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def stripped(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def split_words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def bm25_tokens(text: Column, stop: tuple[str, ...] = BM25_STOP) -> Column:
    """Lower case, ASCII punctuation to spaces, split, stop words dropped, repeats kept."""
    return F.filter(split_words(F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", " ")), lambda t: ~t.isin(*stop))


def word_tokens(text: Column) -> Column:
    """Runs of Unicode word characters in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))


def keywords(text: Column, stop: tuple[str, ...] = KEYWORD_STOP) -> Column:
    """Distinct words of two or more ASCII letters that are no stop words, sorted."""
    return F.array_sort(F.array_distinct(F.filter(letter_words(text), lambda t: ~t.isin(*stop))))


def letter_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b([a-z]{2,})\b"), F.lit(1))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text with white space collapsed, in lower case; punctuation counts."""
    return F.sha2(F.lower(spaced(text)), 256)


def loose(text: Column) -> Column:
    """Lower case, only word characters and white space, collapsed."""
    return spaced(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", ""))


def char_shingles(text: Column, k: int = 3) -> Column:
    """Distinct runs of k characters; a shorter text is its own shingle, an empty one has none."""
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - (k - 1)), lambda i: F.substr(text, i, F.lit(k)))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(text) < k, F.array(text)).otherwise(F.array_distinct(grams))


def word_shingles(text: Column, k: int = 2) -> Column:
    """Distinct runs of k words; of fewer words, the whole text."""
    w = split_words(text)
    grams = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))
    return F.when(F.size(w) < k, F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))).otherwise(F.array_distinct(grams))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Of two arrays as sets; one empty gives 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def sentences(text: Column, min_length: int = 0) -> Column:
    """Split after . ! ? and white space, trimmed; shorter ones dropped."""
    parts = F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), stripped)
    return F.filter(parts, lambda s: (s != "") & (F.length(s) >= min_length))


def sentences_before_capital(text: Column) -> Column:
    """Split only where the next sentence begins with an ASCII capital."""
    return F.filter(F.transform(F.split(stripped(text), r"(?U)(?<=[.!?])\s+(?=[A-Z])"), stripped), lambda s: s != "")


def capitalise(text: Column) -> Column:
    return F.concat(F.upper(F.substr(text, F.lit(1), F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def script(text: Column) -> Column:
    """The script most characters have: latin, cjk, arabic, cyrillic, in this order on ties; unknown without any."""
    # Character ranges of the scripts.
    classes = (
        ("latin", "A-Za-zÀ-ÖØ-öø-ÿ"),
        ("cjk", "一-鿿぀-ヿ가-힯"),
        ("arabic", "؀-ۿ"),
        ("cyrillic", "Ѐ-ӿ"),
    )
    counts = [F.length(F.regexp_replace(text, f"[^{r}]", "")) for _, r in classes]
    best = F.greatest(*counts)
    out = F.when(best == 0, "unknown")
    for (name, _), n in zip(classes, counts):
        out = out.when(n == best, name)
    return out
