"""The crawl over pages: from seeds along the links of fetched documents, state in versioned tables, one step a version.

A step takes all pending URLs of the least depth, joins them to what was fetched for them, routes each by its outcome,
draws the links from the documents that are kept (pages, style sheets, scripts, JSON bodies, robots files, sitemaps), and
commits what changes: the URLs that are done with, the pending ones with what is new, visited rows, the URL map and the
errors. Only documents of the step's URLs are read for links; URLs that are done with are never taken again. Links that
cost no depth are followed at their own depth, before anything deeper. A step that dies leaves the version before it.

`frontier` is the union of both tables of URLs. A URL keeps the least depth at which it was found while it was pending.
Hot targets are put together where they are found, and scope is tested once for each target.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webweft.functions import dom, extract, paths, predicates, render, urls
from webweft.operators import json_walk, scan
from webweft.operators.shared import new_folder, written
from webweft.operators.snapshots import Snapshots

SCHEMAS = {
    "processed": "url string, depth int, status string, added_at long, reason string",
    "pending": "url string, depth int, added_at long",
    "visited": "url string, status_code int, final_url string, content_type string, file_path string, fetched_at long",
    "url_map": "url string, file_path string, kind string, seq long",
    "errors": "id long, url string, error string, at long",
    "origins": "origin string",
}
#: What a link is by: an element (its tag and flags tell its weight), a style sheet, a script, a JSON body, or a numbered page.
LINK = "depth int, base string, href string, by string, tag string, is_stylesheet boolean, is_script boolean"


@dataclass(frozen=True)
class Rules:
    """What a crawl follows. max_depth: of links; paging: numbered pages of a page at most."""

    max_depth: int = 2
    same_host: bool = True
    aliases: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    exclude_types: tuple[str, ...] = ()
    probing: bool = False
    sitemaps: bool = True
    paging: int = 50


def reason_text(error: Column, status: Column) -> Column:
    """Why a fetch failed: its error, or its status, or that nothing is known."""
    return F.when(error != "", error).when(status > 0, F.concat(F.lit("HTTP "), status.cast("string"))).otherwise("Unknown fetch error")


@lru_cache(maxsize=4)
def _meant(application: str) -> Column:
    """What a reference (href) means on its base: a canonical URL's parts. One long expression, made once for all steps."""
    return urls.canonicalize(urls.resolve(urls.url_parse("base"), "href"))


def in_scope(rows: DataFrame, parsed: str, origins: DataFrame, rules: Rules) -> DataFrame:
    """Adds scoped: an http(s) URL on the origin of a seed, or an alias host, or any if hosts don't matter.

    parsed: the column with the URL's parts.
    """
    u = F.col(parsed)
    web = u.isNotNull() & u["scheme"].isin("http", "https") & (u["host"] != "")
    if not rules.same_host:
        return rows.withColumn("scoped", F.coalesce(web, F.lit(False)))
    names = [predicates.normalize_alias(a) for a in rules.aliases]
    alias = u["host"].isin(*names) if names else F.lit(False)
    known = origins.select(F.col("origin").alias("_origin"), F.lit(True).alias("_known"))
    met = rows.withColumn("_here", urls.origin(u)).join(known, F.col("_here") == F.col("_origin"), "left")
    near = F.coalesce(F.col("_known"), F.lit(False)) | F.coalesce(alias, F.lit(False))
    return met.withColumn("scoped", F.coalesce(web & near, F.lit(False))).select(*rows.columns, "scoped")


def routed(batch: DataFrame, responses: DataFrame, origins: DataFrame, rules: Rules) -> DataFrame:
    """The batch with its responses and their outcome: status (done, skipped, failed), reason, logged (whether an error
    row is due), final_url, file_path, kind.

    batch: url, depth, added_at. responses: url (identity key), status_code, content_type, final_url, body, error; a URL
    without a row was not answered. More rows of a URL: the least by status and final URL counts.
    """
    one = responses.groupBy("url").agg(F.min(F.struct("status_code", "final_url", "content_type", "error", "body")).alias("r"))
    got = batch.join(one, "url", "left")
    code, error = F.coalesce("r.status_code", F.lit(0)), F.coalesce("r.error", F.lit(""))
    got = got.select(*batch.columns, code.alias("status_code"), error.alias("error"), predicates.mime_of(F.coalesce("r.content_type", F.lit(""))).alias("content_type"), F.coalesce("r.body", F.lit("")).alias("body"), F.coalesce(F.nullif("r.final_url", F.lit("")), "url").alias("_final"))
    got = got.withColumn("_parsed", urls.canonicalize(urls.url_parse("_final")))
    got = in_scope(got.withColumn("final_url", urls.to_string(F.col("_parsed"), False)), "_parsed", origins, rules)
    good = (F.col("error") == "") & F.col("status_code").between(200, 399)
    missing = F.col("status_code").isin(404, 410, *((401, 403, 405) if rules.probing else ()))
    typed = predicates.content_type_allowed(F.col("content_type"), list(rules.exclude_types))
    allowed = predicates.url_allowed(F.col("final_url"), list(rules.include), list(rules.exclude))
    status = F.when(~good & missing, "skipped").when(~good | F.col("_parsed").isNull(), "failed").when(~(F.col("scoped") & typed & allowed), "skipped").otherwise("done")
    why = (
        F.when(~good, reason_text(F.col("error"), F.col("status_code")))
        .when(F.col("_parsed").isNull(), "invalid final URL")
        .when(~F.col("scoped"), "out of scope")
        .when(~typed, "content type")
        .when(~allowed, "URL rule")
    )
    kind = predicates.content_kind(F.col("content_type"), F.col("_parsed.path"), F.col("body"))
    done = F.col("status") == "done"
    got = got.withColumns({"status": status, "reason": why, "logged": ~good & ~missing})
    return got.select(*batch.columns, "status_code", "content_type", "status", "reason", "logged", "final_url", F.when(done, paths.local_path(F.col("_parsed"))).alias("file_path"), F.when(done, kind).alias("kind"), "body")


def found_links(done: DataFrame, rules: Rules) -> DataFrame:
    """Links of kept documents as LINK has them, written; a null depth counts from nothing.

    done: url, depth, final_url, kind, body: a written table. Each kind of document has a branch of its own.
    """
    every: list[DataFrame] = []

    def add(rows: DataFrame, by: str, *more: str) -> None:
        tag, sheet, script = more or (F.lit(None).cast("string"), F.lit(False), F.lit(False))
        every.append(rows.select("depth", "base", "href", F.lit(by).alias("by"), F.col(tag) if more else tag.alias("tag"), F.col(sheet) if more else sheet.alias("is_stylesheet"), F.col(script) if more else script.alias("is_script")))

    pages = done.filter("kind = 'html'").select(F.struct("url", "depth", "final_url").alias("page"), F.col("body").alias("html"))
    found = written(dom.elements(pages), "elements")
    # A page's base element moves its base; it may be relative itself.
    moved = dom.base_href(found.withColumns({"url": F.col("page.url"), "final": F.col("page.final_url")}), "url")
    finals = done.select("url", F.col("final_url").alias("base"))
    moved = moved.withColumnRenamed("base", "href").join(finals, "url").withColumn("to", urls.to_string(_meant(done.sparkSession.sparkContext.applicationId), False))
    moved = written(moved.select("url", "to"), "bases")
    base = F.coalesce(F.nullif("to", F.lit("")), "final_url").alias("base")
    based = lambda rows, *more: rows.select("page.url", "page.depth", "page.final_url", *more).join(moved, "url", "left").withColumn("base", base)
    add(based(dom.links(found), F.col("url").alias("href"), "tag", "is_stylesheet", "is_script"), "element", "tag", "is_stylesheet", "is_script")
    value = lambda name: F.get("values", F.array_position("names", F.lit(name)).cast("int") - 1)
    sheets = found.filter("tag = 'style' OR array_contains(names, 'style')").select("page", F.explode(F.array(F.when(F.col("tag") == "style", F.col("text")), value("style"))).alias("css"))
    add(based(sheets.filter("css IS NOT NULL"), F.explode(extract.css_urls("css")).alias("href")), "style")
    add(based(found.filter("tag = 'script' AND NOT array_contains(names, 'src')"), F.explode(extract.js_urls("text")).alias("href")), "script")
    whole = lambda kind: done.filter(F.col("kind") == kind).select("url", "depth", F.col("final_url").alias("base"), "body")
    numbers = whole("html").select("depth", "base", F.explode(extract.page_numbers("body", rules.paging)).alias("n")).filter("n > 1")
    add(numbers.withColumn("href", urls.with_page(urls.url_parse("base"), F.col("n"))), "page")

    add(whole("css").select("depth", "base", F.explode(extract.css_urls("body")).alias("href")), "style")
    add(whole("js").select("depth", "base", F.explode(extract.js_urls("body")).alias("href")), "script")
    json = whole("json")
    if not json.isEmpty():
        bodies = json.select(F.col("url").alias("id"), "body", F.col("base").alias("source"))
        leaves = json_walk.leaves(bodies)
        at = json.select(F.col("url").alias("id"), "depth", "base")
        add(json_walk.json_urls(leaves).withColumnRenamed("url", "href").join(at, "id"), "json")
        add(json_walk.json_pages(leaves, bodies, rules.paging).withColumnRenamed("url", "href").join(at, "id"), "json page")

    if rules.sitemaps:
        # What robots files and sitemaps name counts from nothing, wherever they were found.
        path = F.regexp_extract("final_url", r"^[^:]+://[^/?#]*([^?#]*)", 1)
        at = done.select(F.lit(None).cast("int").alias("depth"), F.col("final_url").alias("base"), "body", path.alias("_path"))
        told = F.concat(extract.robots_sitemaps("body"), extract.robots_hints("body")) if rules.probing else extract.robots_sitemaps("body")
        add(at.filter("_path = '/robots.txt'").withColumn("href", F.explode(told)), "sitemap")
        maps = at.filter(render.is_sitemap_path(F.col("_path")) | render.is_sitemap_body(F.col("body")))
        add(maps.withColumn("href", F.explode(extract.sitemap_locs("body"))), "sitemap")
    return written(reduce(DataFrame.unionByName, every), "links")


def targets(found: DataFrame, origins: DataFrame, rules: Rules) -> DataFrame:
    """url and least depth of what links lead to: resolved, in scope, by the rules, within depth."""
    meant = found.filter(~urls.should_ignore("href")).withColumn("u", _meant(found.sparkSession.sparkContext.applicationId)).filter("u IS NOT NULL")
    path = F.col("u.path")
    weight = (
        F.when(F.col("by") == "element", predicates.link_weight(F.col("tag"), F.col("is_stylesheet"), F.col("is_script"), path))
        .when(F.col("by") == "script", predicates.script_weight(path))
        .when(F.col("by") == "json", predicates.json_weight(path))
        .when(F.col("by") == "page", 1)
        .otherwise(0)
    )
    reached = meant.withColumn("depth", F.coalesce(F.col("depth") + weight, F.lit(0)).cast("int")).filter(F.col("depth") <= rules.max_depth)
    # Written before it is shuffled: the long expression is planned once, not again with each exchange.
    once = written(reached.select("u", "depth"), "reached").groupBy("u").agg(F.min("depth").alias("depth"))
    scoped = in_scope(once, "u", origins, rules).filter("scoped").select(urls.to_string(F.col("u"), False).alias("url"), "depth")
    return scoped.filter(predicates.url_allowed(F.col("url"), list(rules.include), list(rules.exclude)))


def start(spark: SparkSession, seeds: DataFrame, rules: Rules, root: str, extra: DataFrame | None = None) -> Snapshots:
    """A crawl's tables in a folder: those that are there, or new ones that begin with the seeds.

    seeds: url; extra: url, further addresses at depth 0, within the seeds' scope.
    """
    state = Snapshots(spark, root, SCHEMAS)
    if state.current() is None:
        keys = seeds.select(urls.canonical_key("url").alias("url")).filter("url <> ''").distinct()
        origins = state.write("origins", keys.select(urls.origin(urls.url_parse("url")).alias("origin")).filter("origin IS NOT NULL").distinct())
        every = keys.withColumn("depth", F.lit(0))
        if extra is not None:
            known = spark.read.schema(SCHEMAS["origins"]).parquet(origins)
            more = extra.select(F.lit(0).alias("depth"), F.col("url").alias("base"), F.col("url").alias("href"), F.lit("extra").alias("by"), F.lit("").alias("tag"), F.lit(False).alias("is_stylesheet"), F.lit(False).alias("is_script"))
            every = every.unionByName(targets(more, known, rules)).groupBy("url").agg(F.min("depth").alias("depth"))
        state.commit({"origins": origins, "pending": state.write("pending", every.withColumn("added_at", F.lit(0)))}, note="seeds")
    return state


def step(state: Snapshots, responses: DataFrame, rules: Rules) -> bool:
    """Take the pending URLs of the least depth and commit what comes of them; False if nothing is pending."""
    pending, done_before = state.read("pending"), state.read("processed")
    depth = pending.agg(F.min("depth")).first()[0]
    if depth is None:
        return False
    number = (state.current() or 0) + 1
    origins = state.read("origins")
    fetched = written(routed(pending.filter(F.col("depth") == depth), responses, origins, rules), "fetched")
    kept = fetched.filter("status = 'done'")
    processed = state.write("processed", fetched)
    new = targets(found_links(kept, rules), origins, rules)
    every_done = done_before.select("url").unionByName(fetched.select("url"))
    rest = pending.filter(F.col("depth") > depth).unionByName(new.join(every_done, "url", "left_anti").withColumn("added_at", F.lit(number).cast("long")))
    left = state.write("pending", rest.groupBy("url").agg(F.min("depth").alias("depth"), F.min("added_at").alias("added_at")))
    visited = state.write("visited", kept.withColumn("fetched_at", F.lit(number)))
    own = kept.select(F.col("final_url").alias("url"), "file_path", "kind")
    moved = kept.filter("url <> final_url").select("url", "file_path", F.lit("redirect").alias("kind"))
    mapped = state.write("url_map", own.unionByName(moved).withColumn("seq", F.lit(number)))
    last = state.read("errors").agg(F.max("id")).first()[0] or 0
    bad = scan.numbered(fetched.filter("logged").select("url", F.col("reason").alias("error")), ["url", "error"], "id")
    errors = state.write("errors", bad.withColumns({"id": F.col("id") + last, "at": F.lit(number)}))
    state.commit({"processed": processed, "visited": visited, "url_map": mapped, "errors": errors}, {"pending": left}, note=f"depth {depth}")
    return True


def crawl(spark: SparkSession, seeds: DataFrame, responses: DataFrame, rules: Rules, root: str | None = None, most_steps: int | None = None, extra: DataFrame | None = None) -> Snapshots:
    """Steps until nothing is pending, or so many; called again with the same folder it goes on where it stopped."""
    state = start(spark, seeds, rules, root or new_folder(spark, "crawl"), extra)
    steps = 0
    while (most_steps is None or steps < most_steps) and step(state, responses, rules):
        steps += 1
    return state


def frontier(state: Snapshots) -> DataFrame:
    """url, depth, status, added_at, reason of every URL that was found."""
    waiting = state.read("pending").select("url", "depth", F.lit("pending").alias("status"), "added_at", F.lit(None).cast("string").alias("reason"))
    return state.read("processed").unionByName(waiting)


def url_map(state: Snapshots) -> DataFrame:
    """The mapping: of rows of one URL the last written counts, a document's own before a redirect to it."""
    rows = state.read("url_map")
    best = F.max_by(F.struct("file_path", "kind"), F.struct("seq", F.col("kind") != "redirect", "file_path", "kind"))
    return rows.groupBy("url").agg(best.alias("m")).select("url", "m.file_path", "m.kind")
