"""Readers and writers of documents: text with front matter, JSON, HTML pages, paged text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = "*.{txt,md,json}"


def read_files(spark: SparkSession, path: str, pattern: str = EXTENSIONS) -> DataFrame:
    """(path, name, raw): one row a file below ``path``, extension filtered, the folders pdf and pdf_markdown left out."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("raw"))
    return files.filter(~F.col("path").rlike(r"/(pdf|pdf_markdown)/"))


def front_matter(raw: Column) -> Column:
    """Front matter between --- and --- or ... as a struct (metadata map with lower-cased keys, body) (S02); without any the whole text is the body."""
    head = r"(?s)^\s*---[ \t]*\n(.*?)\n(?:---|\.\.\.)[ \t]*(?:\n|$)"
    lines = F.filter(F.split(F.regexp_extract(raw, head, 1), "\n"), lambda x: x.contains(":"))
    value = lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)), r"^[\"']|[\"']$", ""))
    entries = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), value(x).alias("v")))
    # A repeated key takes its last value.
    last = F.filter(entries, lambda e, i: F.size(F.filter(F.slice(entries, i + 2, F.greatest(F.lit(1), F.size(entries))), lambda o: o["k"] == e["k"])) == 0)
    return F.struct(F.map_from_entries(last).alias("metadata"), F.regexp_replace(raw, head, "").alias("body"))


def json_document(raw: Column) -> Column:
    """Content, title and dynasty of a JSON document: content, else text, else raw (S03); of invalid JSON all null."""
    at = lambda k: F.get_json_object(raw, f"$.{k}")
    return F.struct(F.coalesce(at("content"), at("text"), at("raw")).alias("content"), at("title").alias("title"), at("dynasty").alias("dynasty"))


def pages_of(docs: DataFrame) -> DataFrame:
    """Pages of paged text (S07): split at form feeds and at lines that say Page N or Trang N; numbered from 1."""
    parts = F.split("text", r"\f|(?m)^\s*(?:Trang|Page)\s+\d+\s*$")
    return docs.select("doc_id", F.posexplode(parts).alias("page", "content")).withColumn("page", F.col("page") + 1).filter("trim(content) <> ''")


#: Elements without content of their own, classes of noise, and where the body is looked for.
DROPPED = {"script", "style", "nav", "footer", "header", "iframe", "noscript", "svg"}
NOISE, VOID = {"ad", "sidebar"}, {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"}
BODIES = ["article", "main", "content", "body"]


class _Page(HTMLParser):
    """Text of the first title and h1 and of each place that can be the body, noise left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, str | None]] = []
        self.text: dict[str, list[str]] = {k: [] for k in ("title", "h1", *BODIES)}
        self.closed: set[str] = set()

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        a = dict(attrs)
        classes = set((a.get("class") or "").split())
        place = tag if tag in self.text else "content" if a.get("id") in ("content", "main-content") or "content" in classes else None
        self.open.append((tag, tag in DROPPED or bool(classes & NOISE), None if place in self.closed else place))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.closed.update(p for _, _, p in self.open[k:] if p)
                del self.open[k:]
                return

    def handle_data(self, data):
        if not any(hidden for _, hidden, _ in self.open):
            for place in {p for _, _, p in self.open if p}:
                self.text[place].append(data)

    def result(self) -> tuple[str, str]:
        said = {k: " ".join("".join(v).split()) for k, v in self.text.items()}
        return said["title"] or said["h1"], next((said[k] for k in BODIES if said[k]), "")


def scrape(pages: DataFrame) -> DataFrame:
    """page_id, title, body of HTML pages (S09): title, else h1; article, main, #content, else body; scripts, navigation and advertisements left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                p = _Page()
                p.feed(r.html or "")
                p.close()
                out.append((r.page_id, *p.result()))
            yield pd.DataFrame(out, columns=["page_id", "title", "body"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, body string")


def tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Names of the catalog's tables."""
    return spark.sql("SHOW TABLES" + (f" IN {database}" if database else ""))


def write_markdown(docs: DataFrame, path: str) -> None:
    """One text record a document with front matter."""
    docs.select(as_markdown(docs.columns, "content").alias("value")).write.mode("overwrite").option("lineSep", "\n\u001e\n").text(path)


def as_markdown(names: list[str], body: str) -> Column:
    """A document's columns as front matter and its body."""
    lines = [F.concat(F.lit(f"{n}: "), F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in names if n != body]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"), F.coalesce(body, F.lit("")))


def read_benchmark(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON arrays with a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def snapshot(df: DataFrame, folder: str, name: str) -> str:
    """Backup of a table under a folder (O12); reading that path restores it."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return f"{folder}/{name}"
