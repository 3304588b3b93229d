"""From fetched documents to the frontier: the links of each kind of document, scope, identity, and rewritten pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webweft.functions import extract, paths, predicates, rewrite, urls
from webweft.functions.text import let
from webweft.operators import json_walk, state

LINK = "array<struct<url:string,origin:string,weight:int>>"


def _as(found: Column, origin: str, weight) -> Column:
    return F.transform(found, lambda u: F.struct(u.alias("url"), F.lit(origin).alias("origin"), weight(u).cast("int").alias("weight")))


def _path(base: Column, url: Column) -> Column:
    """The path of what a reference means: its extension tells pages from assets."""
    return let(urls.resolve(base, url), lambda u: u["path"])


def html_found(html: Column, base: Column, paging: int) -> Column:
    """All links of a page: elements, inline styles and scripts, numbered pages. base: parsed."""
    none = F.array().cast(LINK)
    elements = F.transform(extract.html_links(html), lambda x: F.struct(x["url"].alias("url"), F.lit("element").alias("origin"), predicates.link_weight(x["tag"], x["is_stylesheet"], x["is_script"], _path(base, x["url"])).cast("int").alias("weight")))
    styles = _as(extract.inline_css_urls(html), "style", lambda u: F.lit(0))
    scripts = _as(extract.inline_js_urls(html), "script", lambda u: predicates.script_weight(_path(base, u)))
    numbers = F.transform(F.filter(extract.page_numbers(html, paging), lambda n: n > 1), lambda n: urls.with_page(base, n))
    return F.concat(F.coalesce(elements, none), styles, scripts, _as(numbers, "paging", lambda u: F.lit(1)))


def document_links(documents: DataFrame, paging: int = 50) -> DataFrame:
    """Links of documents by their kind: url, depth, base, href, origin, weight.

    documents: url (canonical), kind, depth, body. A page's base element moves its base; links of style sheets
    cost no depth, numbered pages one as other pages do. JSON bodies are walked apart, by `json_links`.
    """
    parsed = urls.url_parse("url")
    moved = extract.base_href("body")
    base = F.when((F.col("kind") == "html") & (moved != ""), urls.resolve(parsed, moved)).otherwise(parsed)
    rows = documents.select("url", "kind", "depth", "body", base.alias("base"))
    body, own = F.col("body"), F.col("base")
    found = (
        F.when(F.col("kind") == "html", html_found(body, own, paging))
        .when(F.col("kind") == "css", _as(extract.css_urls(body), "style", lambda u: F.lit(0)))
        .when(F.col("kind") == "js", _as(extract.js_urls(body), "script", lambda u: predicates.script_weight(_path(own, u))))
    )
    links = rows.select("url", "depth", "base", F.explode(found).alias("link"))
    return links.select("url", "depth", urls.to_string(F.col("base")).alias("base"), F.col("link.url").alias("href"), "link.origin", "link.weight")


def json_links(documents: DataFrame, paging: int = 50) -> DataFrame:
    """Links of JSON documents, as in `document_links`: the addresses in them, and their other pages at the same depth."""
    bodies = documents.filter("kind = 'json'").select(F.col("url").alias("id"), "body", F.col("url").alias("source"), "depth")
    leaves = json_walk.leaves(bodies)
    found = json_walk.json_urls(leaves).select("id", F.col("url").alias("href"), F.lit("json").alias("origin"))
    pages = json_walk.json_pages(leaves, bodies, paging).select("id", F.col("url").alias("href"), F.lit("paging").alias("origin"))
    both = found.unionByName(pages).join(bodies.select("id", "depth"), "id")
    weight = F.when(F.col("origin") == "paging", 0).otherwise(predicates.json_weight(_path(urls.url_parse("id"), F.col("href"))))
    return both.select(F.col("id").alias("url"), "depth", F.col("id").alias("base"), "href", "origin", weight.cast("int").alias("weight"))


def enqueue_links(links: DataFrame, frontier: DataFrame, visited: DataFrame, seed: str, max_depth: int, aliases: list[str] = (), same_host: bool = True, allowed=None) -> DataFrame:
    """The frontier with the links' targets: resolved, in scope, canonical, within depth, each once at its least depth.

    links: base, href, depth, weight. allowed: a rule for the canonical text, by default any.
    """
    target = F.when(~urls.should_ignore("href"), urls.resolve_key("base", "href"))
    reached = links.select(target.alias("url"), (F.col("depth") + F.col("weight")).alias("depth")).filter((F.col("url") != "") & (F.col("depth") <= max_depth))
    # Before the tests each target is one row: hot targets are put together where they are found.
    once = reached.groupBy("url").agg(F.min("depth").alias("depth"))
    origin = urls.canonicalize(urls.url_parse(F.lit(seed)))
    rule = F.lit(True) if allowed is None else allowed(F.col("url"))
    kept = once.filter(predicates.in_scope(urls.url_parse("url"), origin, list(aliases), same_host, rule))
    return state.enqueue(frontier, visited, kept.withColumn("added_at", F.col("depth").cast("long")))


def rewritten_pages(pages: DataFrame, url_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, html for reading offline; the mapping with pending rows for targets that it lacked).

    pages: key, url (canonical), file_path, html. url_map: url, file_path, kind. A link's target is looked up by its
    canonical text; where it has no path yet it gets the one that its URL means.
    """
    found = F.concat(F.transform(extract.html_links("html"), lambda x: x["url"]), extract.inline_css_urls("html"))
    hrefs = F.array_distinct(F.transform(F.filter(found, lambda u: ~urls.should_ignore(u)), lambda u: F.substring_index(u, "#", 1)))
    links = pages.select("key", "url", "file_path", F.explode(F.filter(hrefs, lambda u: u != "")).alias("href"))
    links = links.withColumn("target", urls.resolve_key("url", "href")).filter("target != ''")
    wanted = links.select(F.col("target").alias("url"), paths.local_path(urls.url_parse("target")).alias("file_path"))
    whole = state.assign_paths(url_map, wanted)
    known = whole.select(F.col("url").alias("target"), F.col("file_path").alias("target_path"))
    mapped = links.join(known, "target").withColumn("new", paths.relative_path("file_path", "target_path"))
    maps = mapped.groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("href", "new"))).alias("mapping"))
    rows = pages.join(maps, "key", "left")
    html = F.when(F.col("mapping").isNull(), F.col("html")).otherwise(rewrite.page_rewrite("html", F.col("mapping")))
    return rows.select("key", html.alias("html")), whole
