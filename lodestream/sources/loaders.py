"""Loaders: files and tables to documents (doc_id, text, source, title, format, extra)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes and what they hold.
FORMATS = {".txt": "text", ".md": "markdown", ".pdf": "pdf", ".html": "html", ".htm": "html", ".json": "json", ".jsonl": "json", ".csv": "csv", ".tsv": "csv"}
DROPPED = frozenset(("script", "style", "nav", "footer", "header"))


def format_of(path: str) -> str | None:
    """The format of a path by its suffix, upper or lower case; None for others."""
    m = re.search(r"\.[A-Za-z]+$", path)
    return FORMATS.get(m[0].lower()) if m else None


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def documents(df: DataFrame, text: Column, source: Column, title: Column, fmt: str, extra: Column | None = None) -> DataFrame:
    """doc_id is the SHA-256 of the source: the same for the same file on every run."""
    return df.select(F.sha2(source, 256).alias("doc_id"), text.alias("text"), source.alias("source"), title.alias("title"), F.lit(fmt).alias("format"), (F.create_map().cast("map<string,string>") if extra is None else extra).alias("extra"))


def load_text(spark: SparkSession, path: str, glob: str = "*.{txt,md}") -> DataFrame:
    """One document per file; directories are read with all below them."""
    d = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return documents(d, F.col("value"), F.col("file"), stem(F.col("file")), "text")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.in_title, self.title, self.parts = 0, False, "", []

    def handle_starttag(self, tag, attrs):  # noqa: ANN001
        self.skip += tag in DROPPED
        self.in_title |= tag == "title"

    def handle_endtag(self, tag):  # noqa: ANN001
        self.skip -= tag in DROPPED and self.skip > 0
        self.in_title &= tag != "title"

    def handle_data(self, data):  # noqa: ANN001
        if self.in_title and not self.title:
            self.title = data.strip()
        if not self.skip:
            self.parts.append(data)


def html_text(html: str) -> tuple[str, str]:
    """(title, text): without script, style, nav, footer and header; lines trimmed, blank runs collapsed."""
    p = _Text()
    p.feed(html)
    p.close()
    lines = [line.strip() for line in "\n".join(p.parts).split("\n")]
    return p.title, re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def parse_html(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, title, text) of a table of pages. HTML needs a parser: it runs over Arrow batches."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(None, None) if x is None else html_text(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in got], pa.string()), pa.array([x for _, x in got], pa.string())], [key, "title", "text"])

    return df.select(key, html).mapInArrow(parse, f"{key} {df.schema[key].dataType.simpleString()}, title string, text string")


def load_html(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.option("pathGlobFilter", "*.{html,htm}").option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("html"))
    return documents(parse_html(d, "file"), F.col("text"), F.col("file"), F.col("title"), "html")


def row_text(columns: list[str], all_columns: list[str]) -> Column:
    """The chosen columns by line, else all as name: value. A missing value is empty."""
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    if columns:
        return F.concat_ws("\n", *[value(c) for c in columns])
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), value(c)) for c in all_columns])


def documents_from_rows(df: DataFrame, key: str, content: list[str] | None = None, title: str | None = None, source: str = "<memory>") -> DataFrame:
    """One document per row of any table: key names the row in its source."""
    src = F.concat(F.lit(f"{source}#row"), F.col(key).cast("string"))
    name = F.col(title).cast("string") if title else F.concat(F.lit("row["), F.col(key).cast("string"), F.lit("]"))
    return documents(df, row_text(content or [], df.columns), src, name, "csv")


def numbered(d: DataFrame) -> DataFrame:
    """d with _file and _row: the number of a record in its file, or, of a file that is read in splits, in its split, with the split's
    place before it. The same files read with the same settings give the same numbers, wherever they run."""
    d = d.withColumn("_file", F.col("_metadata.file_path")).withColumn("_at", F.col("_metadata.file_block_start")).withColumn("_id", F.monotonically_increasing_id())
    first = d.groupBy("_file", "_at").agg(F.min("_id").alias("_first"))  # one row a split
    row = (F.col("_id") - F.col("_first")).cast("string")
    numbers = F.when(F.col("_at") > 0, F.concat(F.col("_at").cast("string"), F.lit("+"), row)).otherwise(row)
    return d.join(first, ["_file", "_at"]).withColumn("_row", numbers).drop("_at", "_id", "_first")


def load_csv(spark: SparkSession, path: str, content: list[str] | None = None, title: str | None = None) -> DataFrame:
    """One document per record of CSV and TSV files with a header; a record is known by its file and its number there."""
    sep = "\t" if path.lower().endswith(".tsv") else ","
    d = spark.read.option("header", "true").option("sep", sep).option("multiLine", "true").option("escape", '"').csv(path)
    cols = d.columns
    d = numbered(d)
    name = F.col(title) if title else F.concat(stem(F.col("_file")), F.lit("["), F.col("_row"), F.lit("]"))
    return documents(d, row_text(content or [], cols), F.concat("_file", F.lit("#row"), F.col("_row")), name, "csv")


def load_json(spark: SparkSession, path: str, content_key: str | None = None, title_key: str | None = None, metadata_keys: tuple[str, ...] = ()) -> DataFrame:
    """One document per record: JSON lines, or a file that holds an object or an array. Malformed lines raise."""
    lines = path.lower().endswith(".jsonl")
    d = spark.read.option("mode", "FAILFAST").option("multiLine", str(not lines).lower()).json(path)
    cols = d.columns
    d = numbered(d)
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols]))
    text = F.coalesce(F.col(content_key).cast("string"), whole) if content_key in cols else whole
    name = F.col(title_key).cast("string") if title_key in cols else F.concat(stem(F.col("_file")), F.lit("["), F.col("_row"), F.lit("]"))
    keys = [k for k in metadata_keys if k in cols]
    extra = F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k).cast("string"))]) if keys else None
    return documents(d, text, F.concat("_file", F.lit("#"), F.col("_row")), name, "json", extra)


def front_matter(text: Column) -> tuple[Column, Column]:
    """(map, body): a leading --- block, each line cut at its first colon, all values strings."""
    block = F.regexp_extract(text, r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("v")))
    pairs = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    return F.map_from_entries(pairs), F.regexp_replace(text, r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\z)", "")


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(" \t\n\r\f\x0b"))


def markdown_sections(body: Column, min_chars: int = 50) -> Column:
    """Spans from one ATX heading to the next as (section_index, heading, content); short ones go but keep their number; what stands
    before the first heading goes; without any section left the body is one."""
    parts = F.filter(F.split(body, r"(?m)(?=^#{1,6}[ \t]+)"), lambda p: p.rlike(r"\A#{1,6}[ \t]+"))
    made = F.transform(parts, lambda p, i: F.struct(i.alias("section_index"), F.trim(F.regexp_extract(p, r"\A#{1,6}[ \t]+([^\n]*)", 1)).alias("heading"), stripped(p).alias("content")))
    kept = F.filter(made, lambda s: F.length(s["content"]) >= min_chars)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.struct(F.lit(0).alias("section_index"), F.lit("").alias("heading"), stripped(body).alias("content"))))


def load_markdown(spark: SparkSession, path: str, sections: bool = False, images: bool = True, min_chars: int = 50, glob: str = "*.md") -> DataFrame:
    d = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    meta, body = front_matter(F.col("raw"))
    d = d.select("file", meta.alias("meta"), body.alias("body"))
    if not images:
        d = d.withColumn("body", F.regexp_replace("body", r"!\[[^\]]*\]\([^)]*\)", ""))
    title = F.coalesce(F.try_element_at("meta", F.lit("title")), stem(F.col("file")))
    if not sections:
        return documents(d, stripped(F.col("body")), F.col("file"), title, "markdown", F.col("meta"))
    d = d.withColumn("s", F.explode(markdown_sections(F.col("body"), min_chars)))
    return documents(d, F.col("s.content"), F.concat("file", F.lit("#"), F.col("s.section_index").cast("string")), F.when(F.col("s.heading") == "", title).otherwise(F.col("s.heading")), "markdown", F.col("meta"))


def load_pdf(spark: SparkSession, path: str, per_page: bool = False) -> DataFrame:
    """PDF pages through PyMuPDF where it is installed; an ImportError on the driver otherwise."""
    import fitz  # noqa: F401  optional

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import fitz

        for b in batches:
            for file, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fitz.open(stream=raw, filetype="pdf") as pdf:
                    texts = [p.get_text() for p in pdf]
                rows = [(i + 1, t) for i, t in enumerate(texts) if t.strip()] if per_page else [(0, "\n\n".join(t for t in texts if t.strip()))]
                yield pa.RecordBatch.from_pydict({"file": [file] * len(rows), "page": pa.array([i for i, _ in rows], pa.int32()), "text": pa.array([t for _, t in rows], pa.string())})

    d = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content").mapInArrow(pages, "file string, page int, text string")
    return documents(d, F.col("text"), F.concat("file", F.lit("#page"), F.col("page").cast("string")), stem(F.col("file")), "pdf", F.create_map(F.lit("page_number"), F.col("page").cast("string")))


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """By the path's suffix."""
    of = {"text": load_text, "markdown": load_markdown, "html": load_html, "json": load_json, "csv": load_csv, "pdf": load_pdf}
    kind = format_of(path)
    if kind is None:
        raise ValueError(f"no loader for {path}")
    return of[kind](spark, path, **options)
