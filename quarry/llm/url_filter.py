"""URL rules and redirect equivalence, in DataFrame functions only.

A rule is a host and a path prefix, and fits the host and its subdomains; the longest fitting rule decides. Pages that no rule fits take
the decision of their aliases: connected components over redirect and canonical-link edges carry a block to every alias, unless an
alias is explicitly allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ASCII_LOWER, ASCII_UPPER, columns, connected_components, join_groups, stage

#: (host, path prefix, verdict); fixed values of the contract.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, ASCII_UPPER, ASCII_LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(h: Column, p: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct (rule, verdict), null if none fits. Of equally long ones the longer host, then a block, wins.

    Rules are few and known to the plan, so they are an expression."""
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block", r))
    chain = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, prefix, verdict in reversed(order):
        fits = ((h == rule_host) | h.endswith("." + rule_host)) & p.startswith(prefix)
        chain = F.when(fits, F.struct(F.lit(rule_host + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chain)
    return chain


def links(html: Column) -> Column:
    """Targets of a page's canonical links and meta refreshes, as written."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)(<link\b[^>]*>|<meta\b[^>]*>)"), F.lit(1))
    canonical = F.transform(F.filter(tags, lambda t: t.rlike(r"(?is)\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b")), lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.transform(F.filter(tags, lambda t: t.rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh")), lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    return F.filter(F.concat(canonical, refresh), lambda x: x != "")


def resolved(target: Column, p: Column) -> Column:
    """The path of a target without host or leading slash, seen from a page at path ``p``: in its folder, without dot segments."""
    name = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    steps = F.split(F.concat(F.regexp_extract(p, r"(?s)^/?(.*/)?", 1), name), "/")
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.array_append(done, x)))
    # A last dot segment names a folder.
    folder = F.when(F.element_at(steps, -1).isin(".", "..") & (F.size(walked) > 0), "/").otherwise("")
    return F.when(name == "", p).otherwise(F.concat(F.lit("/"), F.array_join(walked, "/"), folder))


def absolute(target: Column, h: Column, p: Column) -> Column:
    """A link target of the page at ``h`` and ``p`` as a struct (host, path), null if it is no address: one with another scheme (mailto:), or without a host."""
    full = F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(F.lit("x:"), target))
    root = F.when(target.startswith("/"), F.regexp_extract(target, r"(?s)^([^?#]*)", 1)).when(~target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), resolved(target, p))
    found = F.when(full.isNotNull(), F.struct(host(full).alias("host"), path(full).alias("path"))).when(root.isNotNull(), F.struct(h.alias("host"), root.alias("path")))
    return F.when(found["host"] != "", found)


def address(url: Column) -> Column:
    return F.struct(host(url).alias("host"), path(url).alias("path"))


def hashed(end: Column) -> Column:
    return F.xxhash64(F.concat(end["host"], end["path"]))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, redirects: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, component_id.

    A page's address is its host and path; pages with one address are aliases, and so are both ends of a canonical link, a meta refresh, or a row
    of ``redirects`` (from_url, to_url), be they rows of ``pages`` or not; targets are relative to the page. ``verdict`` is the longest fitting rule's; without one it is block if an alias is blocked by a rule and
    none is allowed by one, else allow. A null url, or one without ``://``, has no address: no rule fits, it has no alias, and it is allowed.
    ``component_id`` is the least address hash among the aliases, null without an address. Null html has no links; repeated rows get equal verdicts; further columns are ignored.
    """
    rules = RULES if rules is None else rules
    rows = columns(pages, "page_id", "url", "html")
    rows = rows.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), links(F.col("html")).alias("to"))
    rows = rows.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("node", F.when(F.col("host") != "", F.xxhash64(F.concat("host", "path"))))
    rows = stage(rows)
    total = rows.count()
    ends = rows.filter("node is not null").select(F.struct("host", "path").alias("s"), F.explode("to").alias("t"))
    ends = ends.select("s", absolute(F.col("t"), F.col("s.host"), F.col("s.path")).alias("t")).filter("t is not null")
    if redirects is not None:
        moves = columns(redirects, "from_url", "to_url").select(address(F.col("from_url")).alias("s"), address(F.col("to_url")).alias("t"))
        ends = ends.unionByName(moves.filter("s.host != '' and t.host != ''"))
    ends = stage(ends)
    reached = total + 2 * ends.count()
    parts = connected_components(ends.select(hashed(F.col("s")).alias("a"), hashed(F.col("t")).alias("b")))
    # Both ends of an edge are addresses with rules of their own, whether a page has them or not.
    linked = ends.select(F.explode(F.array("s", "t")).alias("end")).distinct().select(hashed(F.col("end")).alias("node"), longest_rule(F.col("end.host"), F.col("end.path"), rules).alias("fit"), F.lit(0).alias("page"))
    known = rows.filter("node is not null").select("node", "fit", F.lit(1).alias("page")).unionByName(linked)
    nodes = known.groupBy("node").agg(F.sum("page").alias("n"), F.max(F.col("fit.verdict") == "allow").alias("allowed"), F.max(F.col("fit.verdict") == "block").alias("blocked"))
    nodes = stage(nodes.join(parts, "node", "left").withColumn("component_id", F.coalesce("component", "node")).drop("component"))
    decided = nodes.groupBy("component_id").agg(F.sum(F.greatest("n", F.lit(1))).alias("size"), F.coalesce(F.max("allowed"), F.lit(False)).alias("any_allowed"), F.coalesce(F.max("blocked"), F.lit(False)).alias("any_blocked"))
    named = join_groups(nodes.filter("n > 0").select("node", "component_id", F.col("n").alias("_n")), decided, ["component_id"], "size", reached).withColumn("spread", F.when(F.col("any_blocked") & ~F.col("any_allowed"), "block").otherwise("allow"))
    out = join_groups(rows.filter("node is not null").drop("to"), named.select("node", "component_id", "_n", "spread"), ["node"], "_n", total)
    bare = rows.filter("node is null").drop("to").withColumns({"component_id": F.lit(None).cast("long"), "spread": F.lit("allow")})
    every = out.select(*bare.columns).unionByName(bare)
    return every.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "spread").alias("verdict"), "component_id")
