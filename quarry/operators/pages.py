"""Pages of scanned documents: running headers and footers, page numbers and headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines at the top and at the bottom of a page that can be running ones; pages of a document that must have one, at least and as a share.
EDGE, LEAST, SHARE = 2, 3, 0.5
#: Fixed patterns: a page's own number line, numbered headings, and headings in capitals.
NUMBER, HEADER = r"^\d+$", r"(?iu)^(?:trang|page)\s+\d+"
HEADING, CAPITALS = r"(?iu)^(chương|mục|tiết|phần|quyển|chapter|section)\s+[0-9ivxlcdm]+", r"^[\p{Lu}\s]{4,60}$"


def running_key(line: Column) -> Column:
    """What two running lines share: small letters, any number for any other."""
    return F.regexp_replace(F.lower(line), r"\d+", "#")


def structured_pages(pages: DataFrame, edge: int = EDGE, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(doc, page, content) to doc, page, header, footer, headings, content without running lines; null and blank pages have no lines.

    A line among the first ``edge`` of a page is a header if as many pages of the document as ``least`` and ``share`` of them have it there (digits aside), or if it is the first and says the page; likewise
    at the bottom, where the last line may also be a bare number. Only the lines at the edges are exploded, and a document has few running lines, as each is on a share of its pages: what is joined back is small."""
    lines = F.filter(F.transform(F.split(F.coalesce("content", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    p = pages.select("doc", "page", lines.alias("lines"))
    at_top = F.slice("lines", 1, edge)
    at_end = F.slice("lines", F.greatest(F.size("lines") - edge + 1, F.lit(1)), F.lit(edge))
    sides = F.array(F.struct(F.lit("T").alias("side"), at_top.alias("x")), F.struct(F.lit("B").alias("side"), at_end.alias("x")))
    ends = p.select("doc", "page", F.explode(sides).alias("s")).select("doc", "page", "s.side", F.explode(F.array_distinct(F.transform("s.x", running_key))).alias("key"))
    often = ends.groupBy("doc", "side", "key").agg(F.count_distinct("page").alias("n"))
    size = p.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    running = often.join(size, "doc").filter((F.col("n") >= least) & (F.col("n") >= share * F.col("pages")))
    known = running.groupBy("doc").agg(*[F.collect_set(F.when(F.col("side") == s, F.col("key"))).alias(s) for s in "TB"])
    j = p.join(known, "doc", "left")
    among = lambda x, keys: F.array_contains(F.coalesce(F.col(keys), F.array().cast("array<string>")), running_key(x))
    n = F.size("lines")
    top = lambda x, i: (i < edge) & (among(x, "T") | ((i == 0) & x.rlike(HEADER)))
    end = lambda x, i: (i >= n - edge) & ~top(x, i) & (among(x, "B") | ((i == n - 1) & x.rlike(NUMBER)))
    rest = F.filter("lines", lambda x, i: ~top(x, i) & ~end(x, i))
    j = j.select("doc", "page", F.filter("lines", top).alias("header"), F.filter("lines", end).alias("footer"), rest.alias("rest"))
    return j.select("doc", "page", "header", "footer", F.filter("rest", lambda x: x.rlike(HEADING) | x.rlike(CAPITALS)).alias("headings"), F.array_join("rest", "\n").alias("content"))
