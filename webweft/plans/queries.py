"""The engine's queries over the driver's tables, each with SQL written another way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webweft.functions import detect, dom, extract, paths, predicates, render, rewrite, urls
from webweft.operators import events, json_walk, links, patterns, report, state
from webweft.operators.shared import written
from webweft.plans import site_crawl
from webweft.plans.crawl import crawl_depths
from webweft.sources import pages as sources


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def url_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("u")
    rows = _read(spark, sf_dir, "pages").select("page_id", urls.url_parse("url").alias("u"))
    return rows.select("page_id", u.scheme.alias("scheme"), u.host.alias("host"), u.port.alias("port"), u.path.alias("path"), u.query.alias("query"), u.fragment.alias("fragment"), urls.to_string(urls.canonicalize(u), False).alias("canonical"), urls.origin(u).alias("origin"))


def url_resolve_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of each page in document order, and what they mean on its address."""
    found = dom.links(dom.elements(_read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("base"), "html")))
    # A page's links are as many as its text holds.
    order = Window.partitionBy("page_id").orderBy("node", "rule", "nth")
    rows = found.withColumn("position", F.row_number().over(order) - 1)
    return rows.select("page_id", "position", "tag", F.col("url").alias("href"), urls.resolve_key("base", "url").alias("target"))


def out_links_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = url_resolve_links(spark, sf_dir).select("target", urls.url_parse("target")["host"].alias("host"))
    return links.groupBy("host").agg(F.count_distinct("target").alias("targets"), F.count("*").alias("links"))


def local_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", paths.local_path(urls.url_parse("url")).alias("path"))


def _shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    html = F.concat(F.repeat(F.lit('<script src="a.js"></script>'), (d % 10).cast("int")), F.repeat(F.lit('<a href="/x">x</a>'), (d % 7).cast("int")), F.when(d % 3 == 0, "<div data-reactroot></div>").when(d % 3 == 1, "<button onclick=go()>load more</button>").otherwise("<script>fetch('/api')</script>"), F.coalesce("text", F.lit("")))
    return _read(spark, sf_dir, "documents").select("doc_id", html.alias("html"))


def detect_site_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shells(spark, sf_dir).select("doc_id", detect.detect("html").alias("d")).select("doc_id", "d.kind", "d.score", "d.static_anchors", "d.scripts", "d.visible_bytes")


def js_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id").cast("string")
    code = F.concat(F.lit('import x from "./m'), d, F.lit(".js\";\nconst t = 'text'; fetch('/api/"), d, F.lit("?page='); axios.get(\"/data/"), d, F.lit(".json\"); location.href = '/go/"), d, F.lit("';"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(extract.js_urls(code)).alias("position", "url"))


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("User-agent: *\nDisallow: /p"), F.col("page_id").cast("string"), F.lit("/*.php$ # no\nAllow: /\nSitemap: "), F.regexp_replace("url", "#.*", ""), F.lit("\n# Sitemap: http://x/\n"))
    return _read(spark, sf_dir, "pages").select("page_id", F.get(extract.robots_sitemaps(body), F.lit(0)).alias("sitemap"), F.get(extract.robots_hints(body), F.lit(0)).alias("hint"), F.size(extract.robots_hints(body)).alias("hints"))


def css_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id").cast("string")
    css = F.concat(F.lit("/* url(no.png) */ @import 'base"), d, F.lit('.css\' screen; a{background:url("i'), d, F.lit('.png")} b{src:url( j'), d, F.lit(".woff )} c{x:url(data:image/png;base64,AA)}"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(extract.css_refs(css)).alias("position", "ref")).select("doc_id", "position", "ref.url", "ref.is_import")


def frontier_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "pages").select(urls.canonical_key("url").alias("url"), "page_id", (F.col("page_id") % 5).cast("int").alias("depth"), F.col("page_id").alias("added_at"))
    # Of pages of one address the first counts, whichever order they are read in.
    first = rows.filter("page_id % 3 = 0").groupBy("url").agg(F.min_by("depth", "page_id").alias("depth"), F.min("added_at").alias("added_at"))
    frontier = first.select("url", "depth", F.lit("in_progress").alias("status"), "added_at")
    new = rows.unionByName(rows.withColumn("depth", F.col("depth") - 1))
    return state.resume(state.enqueue(frontier, rows.filter("page_id % 3 = 1"), new))


def visited_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return state.upsert(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), "user_id", F.col("event_id"))


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("error"), F.unix_timestamp("ts").alias("at"))


def errors_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest_errors(_errors(spark, sf_dir), 100)


def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), (F.col("event_id") % 7 == 0).alias("ok"), (F.col("event_id") % 3 != 0).alias("timeout"))
    return state.circuit_breaker(rows, "user_id")


def in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("change"))
    return events.in_flight(rows, "user_id", "change", "event_id").select("user_id", "event_id", "in_flight")


def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    nation, customer, orders = (_read(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    edges = (
        nation.select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst"), F.lit(1).alias("weight"))
        .unionByName(customer.select(key("n", "c_nationkey").alias("src"), key("c", "c_custkey").alias("dst"), (F.col("c_custkey") % 2).cast("int").alias("weight")))
        .unionByName(customer.select(key("c", "c_custkey").alias("src"), key("n", "c_nationkey").alias("dst"), F.lit(0).alias("weight")))
        .unionByName(orders.select(key("c", "o_custkey").alias("src"), key("o", "o_orderkey").alias("dst"), F.lit(1).alias("weight")))
    )
    return crawl_depths(spark.createDataFrame([("r0",), ("r1",)], "url string"), edges, 3)


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    body = F.format_string('{"items": [{"url": "/p/%d"}, {"image": "i%d.png", "n": 3}], "next": "/list?page=%d", "page": %d, "total_pages": %d}', d, d, d % 5 + 1, d % 4 + 1, d % 6)
    return _read(spark, sf_dir, "documents").select(d.alias("id"), body.alias("body"), F.lit("http://h.example/list?page=2").alias("source"))


def json_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_walk.json_urls(json_walk.leaves(_json(spark, sf_dir)))


def json_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = _json(spark, sf_dir)
    return json_walk.json_pages(json_walk.leaves(bodies), bodies, 4)


def html_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.format_string("<a data-page=\"3\"></a><a data-page='1'></a><a data-page=\"9999\"></a><a data-page-number=\"%d\"></a>", F.col("page_id") % 7)
    rows = _read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*", "").alias("url"), F.explode(extract.page_numbers(html, 4)).alias("page"))
    return rows.select("page_id", "page", urls.with_page(urls.url_parse("url"), F.col("page")).alias("link"))


def runtime_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_resolve_links(spark, sf_dir)
    found = found.select("page_id", F.concat("target", F.element_at(F.array(F.lit("/API/x"), F.lit("?page=2"), F.lit(".png")), F.col("position") % 3 + 1)).alias("url"))
    anchors = F.col("page_id") % 5
    return report.runtime_signals(found, "page_id", "url").withColumns({"added": report.uplift(anchors), "kind": report.uplifted_kind(F.lit(2), anchors)})


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("page", "asset", "error", "skipped")))
    return _read(spark, sf_dir, "events").select(F.element_at(kinds, (F.col("event_id") % 4 + 1).cast("int")).alias("outcome"), F.unix_timestamp("ts").alias("at"))


def outcome_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counters(_outcomes(spark, sf_dir))


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest says of mappings, read back from its text."""
    mappings = _read(spark, sf_dir, "pages").select("url", F.col("page_id").cast("string").alias("path"))
    text = report.manifest(_outcomes(spark, sf_dir), mappings, {"depth": "2"})
    m = F.from_json("manifest", "config map<string,string>, files array<struct<url string, path string>>, mapped long").alias("m")
    return text.select(m).select(F.col("m.config")["depth"].alias("depth"), "m.mapped", F.explode("m.files").alias("f")).select("depth", "mapped", "f.url", "f.path")


def probe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places to try on every site of the pages, in order: 575 of each."""
    places = sources.probe_paths(spark).select(F.sort_array(F.collect_list(F.struct("position", "path"))).alias("p")).first()["p"]  # fixed values
    origins = _read(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", "^[^:]+://[^/?#]*", 0)).alias("origin")).distinct()
    tried = origins.select("origin", F.posexplode(F.array(*(F.lit(p["path"]) for p in places))).alias("position", "path"))
    return tried.select("origin", "position", F.concat("origin", "path").alias("url"))


def link_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each link of the pages costs, and whether it is one to ignore, with extensions of many kinds put to them."""
    kinds = F.array(*map(F.lit, ("", ".html", ".PHP", ".css", ".js", ".png", ".unknown", "/")))
    tags = F.array(*map(F.lit, ("a", "img", "link", "script", "iframe", "div")))
    found = url_resolve_links(spark, sf_dir).withColumn("n", (F.col("page_id") + F.col("position")).cast("int"))
    rows = found.select("page_id", "position", F.concat("href", F.element_at(kinds, F.col("n") % 8 + 1)).alias("path"), F.element_at(tags, F.col("n") % 6 + 1).alias("tag"), (F.col("n") % 4 == 0).alias("sheet"))
    weight = predicates.link_weight(F.col("tag"), F.col("sheet"), F.col("tag") == "script", F.col("path"))
    return rows.select("page_id", "position", weight.cast("int").alias("link"), predicates.script_weight(F.col("path")).cast("int").alias("script"), predicates.json_weight(F.col("path")).cast("int").alias("json"))


def ignored_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of every scheme, with and without a blank before them, tested against what is never followed."""
    schemes = F.array(*map(F.lit, ("", "mailto:", "TEL:", "javascript:", "data:", "blob:", "about:", "file:", "ftp:", "WS:", "wss:", "https:", " javascript:", "x-javascript:")))
    rows = url_resolve_links(spark, sf_dir).select("page_id", "position", F.concat(F.element_at(schemes, ((F.col("page_id") * 3 + F.col("position")) % 14 + 1).cast("int")), "href").alias("address"))
    return rows.select("page_id", "position", "address", urls.should_ignore("address").alias("ignored"))


def content_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of the pages' bodies, and of the documents', under every type and extension."""
    mimes = F.array(*map(F.lit, ("", "text/html", "Text/CSS", "application/javascript", "application/ld+json", "image/png", "application/xhtml+xml")))
    names = F.array(*map(F.lit, ("/a", "/a.html", "/a.css", "/a.mjs", "/a.json", "/a.png")))
    both = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("body"), F.lit("page").alias("of"))
    both = both.unionByName(_read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("body"), F.lit("document").alias("of")))
    kind = predicates.content_kind(F.element_at(mimes, (F.col("id") % 7 + 1).cast("int")), F.element_at(names, (F.col("id") % 6 + 1).cast("int")), F.col("body"))
    return both.select("of", "id", kind.alias("kind"))


def percent_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts percent-encoded, and decoded again."""
    text = F.coalesce("text", F.lit(""))
    rows = _read(spark, sf_dir, "documents").select("doc_id", text.alias("text"), urls.percent_encode(text).alias("encoded"))
    return rows.select("doc_id", F.md5(F.col("encoded").cast("binary")).alias("encoded"), F.md5(urls.percent_decode("encoded").cast("binary")).alias("decoded"))


def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links within the rules: on their page's origin or an alias host, by include and exclude patterns."""
    rows = url_resolve_links(spark, sf_dir).join(_read(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    other = F.when(F.col("position") % 3 == 0, F.regexp_replace("target", "^https?://[^/]*", "http://CDN.example.org")).when(F.col("position") % 3 == 1, F.regexp_replace("target", "^http(s?)://", "ftp$1://")).otherwise(F.col("target"))
    u = urls.url_parse("other")
    allowed = predicates.url_allowed(F.col("other"), ["/[a-m]", "cdn"], ["TH"])
    tested = predicates.in_scope(u, urls.url_parse("url"), ["https://cdn.example.org:8443/x"], True, allowed)
    return rows.withColumn("other", other).filter(tested).select("page_id", "position", "other")


def pattern_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All targets of links against a table of patterns made of every tenth page's words; which patterns match which."""
    found = written(url_resolve_links(spark, sf_dir).select("page_id", "href", F.col("target").alias("url")), "targets")
    word = F.regexp_extract("href", "^/([a-z]{3,})$", 1)
    rules = found.filter("page_id % 10 = 0").select(word.alias("w")).filter("w <> ''").distinct()
    named = rules.select(F.when(F.length("w") % 2 == 0, "include").otherwise("exclude").alias("option"), F.concat(F.lit("/"), F.left("w", F.lit(5)), F.lit("[A-Z]*$")).alias("pattern"))
    plain = spark.createDataFrame([("exclude", "[0-9]{3}"), ("include", "(the|and)$"), ("include", "[.]NET/.*e?st"), ("exclude", "")], "option string, pattern string")
    return patterns.matches(found, named.unionByName(plain))


def site_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of detection, and whether to render a page, for every kind of site."""
    rows = _shells(spark, sf_dir).withColumn("depth", (F.col("doc_id") % 2).cast("int")).withColumn("n", (F.col("doc_id") % 4).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("dynamic", "hybrid", "static", "static"))), F.col("n") + 1)
    score = F.element_at(F.array(*map(F.lit, (9, 5, 3, 0))), F.col("n") + 1)
    auto = render.should_render(F.col("html"), F.col("depth"), "auto", kind, score)
    forced = render.should_render(F.col("html"), F.col("depth"), "dynamic", kind, score)
    return rows.select("doc_id", F.array_join(detect.detect("html")["reasons"], "; ").alias("reasons"), auto.alias("auto"), forced.alias("forced"))


def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' links enqueued: resolved, canonical, in scope, within depth, not visited, each once at its least depth."""
    pages = _read(spark, sf_dir, "pages")
    key = urls.canonical_key("url")
    done = written(pages.select(key.alias("url"), key.alias("final_url"), F.lit("html").alias("kind"), (F.col("page_id") % 3).cast("int").alias("depth"), F.col("html").alias("body")), "pages")
    rules = site_crawl.Rules(max_depth=2, same_host=False, exclude=("/THE",))
    found = site_crawl.found_links(done, rules)
    visited = found.filter("depth = 0 AND href LIKE '/t%'").select(urls.resolve_key("base", "href").alias("url"))
    new = site_crawl.targets(found, spark.createDataFrame([], "origin string"), rules)
    frontier = spark.createDataFrame([], state.FRONTIER)
    return state.enqueue(frontier, visited, new.withColumn("added_at", F.col("depth").cast("long"))).select("url", "depth", "status")


def crawl_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(seeds, responses) made of the pages: beside each page its host's robots file and sitemap (every third page), and
    answers for what its links lead to: missing, failing, moved to the host's first page, a list of pages, or none."""
    pages = _read(spark, sf_dir, "pages").select("page_id", urls.canonical_key("url").alias("url"), "html")
    pages = pages.groupBy("url").agg(F.min(F.struct("page_id", "html")).alias("p")).select("url", "p.page_id", "p.html")
    pages = written(pages.withColumn("origin", F.regexp_extract("url", "^[^:]+://[^/?#]*", 0)), "pages")
    answer = lambda status, kind, final, body: [F.lit(status).alias("status_code"), F.lit(kind).alias("content_type"), final.alias("final_url"), body.alias("body"), F.lit("").alias("error")]
    own = pages.select("url", *answer(200, "text/html; charset=utf-8", F.col("url"), F.col("html")))
    some = lambda n: F.sort_array(F.collect_list(F.when(F.col("page_id") % 3 == n, F.replace("url", F.lit("&"), F.lit("&amp;")))))
    hosts = pages.groupBy("origin").agg(F.min(F.struct("url", "html")).alias("first"), some(0).alias("listed"), some(1).alias("linked"))
    robots = hosts.select(F.concat("origin", F.lit("/robots.txt")).alias("url"), *answer(200, "text/plain", F.concat("origin", F.lit("/robots.txt")), F.concat(F.lit("User-agent: *\nDisallow: /x\nSitemap: "), "origin", F.lit("/sitemap.xml # all\n"))))
    locs = F.array_join(F.transform("listed", lambda u: F.concat(F.lit("<url><loc> "), u, F.lit(" </loc></url>"))), "")
    maps = hosts.select(F.concat("origin", F.lit("/sitemap.xml")).alias("url"), *answer(200, "application/xml", F.concat("origin", F.lit("/sitemap.xml")), F.concat(F.lit("<urlset>"), locs, F.lit("</urlset>"))))
    hrefs = pages.select("origin", F.explode(F.regexp_extract_all("html", F.lit('<nav>.*?</nav>'), F.lit(0))).alias("nav")).select("origin", F.explode(F.regexp_extract_all("nav", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href")).distinct()
    ends = hrefs.join(hosts, "origin").withColumns({"url": F.concat("origin", "href"), "n": F.length("href") % 5})
    listing = F.concat(F.lit("<base href='/'>"), F.array_join(F.transform("linked", lambda u: F.concat(F.lit("<area href="), u, F.lit(">"))), ""))
    gone = ends.filter("n = 0").select("url", *answer(404, "text/html", F.col("url"), F.lit("no")))
    down = ends.filter("n = 1").select("url", *answer(503, "text/html", F.col("url"), F.lit("later")))
    moved = ends.filter("n = 2").select("url", *answer(200, "", F.concat("first.url", F.lit("#top")), F.col("first.html")))
    lists = ends.filter("n = 3").select("url", *answer(200, "text/html", F.col("url"), listing))
    responses = own.unionByName(robots).unionByName(maps).unionByName(gone).unionByName(down).unionByName(moved).unionByName(lists)
    seeds = robots.select("url").unionByName(hosts.select("first.url"))
    return seeds, written(responses, "responses")


def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl of all hosts to depth 2: every URL found, its least depth, what became of it and why, and what it is."""
    seeds, responses = crawl_corpus(spark, sf_dir)
    state = site_crawl.crawl(spark, seeds, responses, site_crawl.Rules(max_depth=2))
    visited = state.read("visited").select("url", "final_url")
    kinds = site_crawl.url_map(state).select(F.col("url").alias("final_url"), "kind")
    known = visited.join(kinds, "final_url", "left")
    return site_crawl.frontier(state).join(known, "url", "left").select("url", "depth", "status", "reason", "final_url", "kind")


def rewrite_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages rewritten for reading offline through the URL map, which gains the targets that it lacked."""
    pages = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), urls.canonical_key("url").alias("url"), paths.local_path(urls.url_parse("url")).alias("file_path"), "html")
    url_map = pages.select("url", "file_path", F.lit("html").alias("kind"))
    rewritten, _ = links.rewritten_pages(pages, url_map)
    return rewritten.select("key", F.md5(F.col("html").cast("binary")).alias("html"))


def rewrite_css(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style sheets of each document's own words, their references rewritten."""
    word = F.regexp_extract(F.coalesce("text", F.lit("")), "([a-z]+)", 1)
    d = F.col("doc_id").cast("string")
    css = F.concat(F.lit("/* url(no.png) */ @import '"), word, F.lit(".css' screen; a{background:url("), word, d, F.lit(".png)} b{src:url('keep.woff')}"))
    mapping = F.create_map(F.concat(word, F.lit(".css")), F.lit("./c.css"), F.concat(word, d, F.lit(".png")), F.concat(F.lit("./i/"), d))
    return _read(spark, sf_dir, "documents").select("doc_id", rewrite.css_rewrite(css, mapping).alias("css"))


def url_map_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping that knows every second target, with pending rows for the others."""
    targets = url_resolve_links(spark, sf_dir).select(F.col("target").alias("url"), "page_id")
    known = targets.filter("page_id % 2 = 0").select("url").distinct().select("url", F.lit("known").alias("file_path"), F.lit("html").alias("kind"))
    return state.assign_paths(known, targets.select("url", paths.local_path(urls.url_parse("url")).alias("file_path")))


def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    frontier = frontier_enqueue(spark, sf_dir)
    _, taken = state.dequeue(frontier, 20)
    return state.counts(taken, visited_upsert(spark, sf_dir), _errors(spark, sf_dir))


def frontier_dequeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next twenty URLs by depth, age and URL, and the frontier with them in progress and some done."""
    batch, taken = state.dequeue(frontier_enqueue(spark, sf_dir), 20)
    done = batch.filter("added_at % 2 = 0").select("url", F.lit("done").alias("status"))
    return state.mark(taken, done)


def stagnation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rounds of interaction: where two poor rounds in a row end them."""
    rows = _read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 7 % 11).alias("growth"))
    return events.stops_at(rows, "user_id", "growth", "event_id")


def tapped_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last bodies of each page that are still held."""
    rows = _read(spark, sf_dir, "events").select("user_id", "event_id")
    return events.latest(rows, "user_id", 40, F.desc("event_id"))


def network_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of a page: when it has come to rest."""
    rows = _read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 37).alias("ms"), F.when(F.col("event_id") % 3 == 0, -2).otherwise(1).alias("change"))
    flying = events.in_flight(rows, "user_id", "change", "event_id").withColumn("loaded", F.col("event_id") % 5 > 2)
    return events.network_idle(flying, "user_id", "ms", 5000, "loaded", 1200, "event_id")


def json_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: the most useful ones for JSON bodies of each page."""
    e = _read(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("request_id"), "event_type")
    tails = F.array(*map(F.lit, ("/api/x", "/list?page=2", "/d.JSON", "/graphql?cursor=a", "/plain", "")))
    named = e.filter("request_id % 3 > 0").select("page", "request_id", F.concat(F.lit("http://h/"), F.col("event_type"), F.element_at(tails, (F.col("request_id") % 6 + 1).cast("int"))).alias("url"))
    pages = e.select("page").distinct().select("page", F.concat(F.lit("http://h/p"), F.col("page").cast("string")).alias("page_url"))
    return events.json_requests(e.select("page", "request_id"), named, pages, render.json_body_limit(50, False, 0))



QUERIES = {f.__name__: f for f in (url_components, url_resolve_links, out_links_by_host, local_path, detect_site_kind, js_urls, robots, css_refs, frontier_enqueue, visited_upsert, errors_latest, circuit_breaker, in_flight, crawl_bfs, json_urls, json_paging, html_paging, runtime_signals, outcome_counters, manifest_files)}
QUERIES |= {f.__name__: f for f in (probe_paths, link_weights, ignored_links, content_kinds, percent_codec, scope_filter, pattern_rules, site_decisions, crawl_frontier, crawl_pages, rewrite_html, rewrite_css, url_map_assign, state_counts, frontier_dequeue, stagnation, tapped_bodies, network_idle, json_requests)}

_PARTS = """p AS (SELECT page_id, url, html, lower(regexp_extract(url, '^([^:]+)://', 1)) AS scheme, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host,
  regexp_extract(url, '://[^/?#]*(/[^?#]*)', 1) AS raw, regexp_extract(url, '[?]([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages),
q AS (SELECT *, CASE WHEN raw = '' THEN '/' ELSE raw END AS path, scheme || '://' || host AS origin,
  scheme || '://' || host || CASE WHEN raw = '' THEN '/' ELSE raw END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical FROM p)"""
_LINKS = """a AS (SELECT page_id, origin, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM q),
l AS (SELECT page_id, origin, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS position FROM a)"""

ORACLE_SQL = {
    "json_urls": """SELECT doc_id AS id, CAST(i - 1 AS INT) AS position, ['/p/' || doc_id, 'i' || doc_id || '.png', '/list?page=' || (doc_id % 5 + 1)][i] AS url FROM documents, range(1, 4) r(i)""",
    "json_paging": """WITH p AS (SELECT doc_id AS id, 0 AS n, '/list?page=' || (doc_id % 5 + 1) AS url FROM documents
  UNION ALL SELECT doc_id, n, 'http://h.example/list?page=' || n FROM documents, range(1, 5) r(n) WHERE doc_id % 6 > 1 AND n <= doc_id % 6 AND n <> doc_id % 4 + 1)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS INT) AS position, url FROM p""",
    "html_paging": f"""WITH {_PARTS} SELECT page_id, CAST(n AS INT) AS page, origin || path || '?page=' || n AS link FROM q, range(1, 5) r(n) WHERE n IN (1, 3) OR n = page_id % 7""",
    "runtime_signals": f"""WITH {_PARTS}, {_LINKS}, u AS (SELECT page_id, lower(origin || href || ['/API/x', '?page=2', '.png'][position % 3 + 1]) AS url FROM l),
c AS (SELECT page_id, count(*) FILTER (regexp_matches(url, '/api/|graphql|[.]json|format=json')) AS api, count(*) FILTER (regexp_matches(url, 'page=|cursor=|/page/')) AS paging,
  count(*) FILTER (regexp_matches(url, '[.](jpe?g|png|webp|gif|svg)')) AS media, count(*) AS discovered FROM u GROUP BY page_id),
s AS (SELECT *, CAST(3 * (api > 0)::INT + 2 * (paging > 0)::INT + (media >= 4 AND discovered > page_id % 5 + 2)::INT + (discovered >= 8 AND discovered > page_id % 5 + 4)::INT AS INT) AS added FROM c)
SELECT *, CASE WHEN added >= 5 THEN 'dynamic' WHEN added >= 2 THEN 'hybrid' ELSE 'static' END AS kind FROM s""",
    "outcome_counters": """WITH c AS (SELECT list_count([x FOR x IN list(event_id % 4) IF x = 0]) AS pages, count(*) FILTER (event_id % 4 = 1) AS assets, count(*) FILTER (event_id % 4 = 2) AS errors,
  count(*) FILTER (event_id % 4 = 3) AS skipped, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS elapsed FROM events) SELECT *, pages + assets AS total_files FROM c""",
    "manifest_files": """SELECT '2' AS depth, (SELECT count(*) FROM pages) AS mapped, url, CAST(page_id AS VARCHAR) AS path FROM pages ORDER BY url, CAST(page_id AS VARCHAR) LIMIT 100""",
    "url_components": f"WITH {_PARTS} SELECT page_id, scheme, host, CAST(CASE scheme WHEN 'http' THEN 80 ELSE 443 END AS INT) AS port, path, query, fragment, canonical, origin FROM q",
    "url_resolve_links": f"WITH {_PARTS}, {_LINKS} SELECT page_id, CAST(position AS INT) AS position, 'a' AS tag, href, origin || href AS target FROM l",
    "out_links_by_host": f"WITH {_PARTS}, {_LINKS} SELECT regexp_extract(origin, '://(.*)', 1) AS host, count(DISTINCT origin || href) AS targets, count(*) AS links FROM l GROUP BY 1",
    "local_path": f"""WITH {_PARTS}, f AS (SELECT *, CASE WHEN path LIKE '%/' THEN path || 'index.html' WHEN NOT regexp_matches(path, '[^/][.][^./]+$') THEN path || '/index.html'
  WHEN regexp_matches(path, '[.](php|asp|aspx|jsp)$') THEN regexp_replace(path, '[.][a-z]+$', '.html') ELSE path END AS named FROM q)
SELECT page_id, 'site/' || host || CASE WHEN query = '' THEN named ELSE regexp_replace(named, '([.][^.]*)$', '__q_' || left(md5(query), 8) || '\\1') END AS path FROM f""",
    "detect_site_kind": """WITH h AS (SELECT doc_id, repeat('<script src="a.js"></script>', CAST(doc_id % 10 AS INT)) || repeat('<a href="/x">x</a>', CAST(doc_id % 7 AS INT)) ||
  CASE doc_id % 3 WHEN 0 THEN '<div data-reactroot></div>' WHEN 1 THEN '<button onclick=go()>load more</button>' ELSE '<script>fetch(''/api'')</script>' END || coalesce(text, '') AS html FROM documents),
c AS (SELECT doc_id, html, lower(html) AS low, doc_id % 7 AS anchors, doc_id % 10 + CASE WHEN doc_id % 3 = 2 THEN 1 ELSE 0 END AS scripts,
  octet_length(encode(replace(regexp_replace(html, '<[^>]*(>|$)', '', 'g'), '>', ''))) AS seen FROM h),
s AS (SELECT *, CASE WHEN contains(low, 'data-reactroot') OR contains(low, 'svelte') THEN 5 ELSE 0 END
  + CASE WHEN scripts >= 8 AND anchors <= 2 THEN 3 WHEN scripts >= 5 AND anchors <= 4 THEN 2 ELSE 0 END + CASE WHEN seen < 250 AND scripts >= 4 THEN 2 ELSE 0 END
  + CASE WHEN contains(low, 'onclick') THEN 2 ELSE 0 END + CASE WHEN contains(low, 'fetch(') AND scripts >= 1 THEN 2 ELSE 0 END
  + CASE WHEN scripts >= 1 AND anchors <= 1 AND seen < 300 THEN 1 ELSE 0 END AS score FROM c)
SELECT doc_id, CASE WHEN score >= 7 THEN 'dynamic' WHEN score >= 4 THEN 'hybrid' ELSE 'static' END AS kind, CAST(score AS INT) AS score, CAST(anchors AS INT) AS static_anchors, CAST(scripts AS INT) AS scripts, CAST(seen AS INT) AS visible_bytes FROM s""",
    "js_urls": """SELECT doc_id, CAST(i - 1 AS INT) AS position, ['./m' || doc_id || '.js', '/data/' || doc_id || '.json', '/go/' || doc_id][i] AS url FROM documents, range(1, 4) r(i)""",
    "robots": """SELECT page_id, regexp_replace(url, '#.*', '') AS sitemap, '/p' || page_id || '/' AS hint, CAST(1 AS INT) AS hints FROM pages""",
    "css_refs": """SELECT doc_id, CAST(i - 1 AS INT) AS position, ['base' || doc_id || '.css', 'i' || doc_id || '.png', 'j' || doc_id || '.woff'][i] AS url, i = 1 AS is_import FROM documents, range(1, 4) r(i)""",
    "frontier_enqueue": f"""WITH {_PARTS}, r AS (SELECT canonical AS url, page_id, page_id % 5 AS depth FROM q),
f AS (SELECT url, any_value(depth) AS depth, any_value(page_id) AS added_at FROM r WHERE page_id % 3 = 0 GROUP BY url)
SELECT url, CAST(depth AS INT) AS depth, 'pending' AS status, added_at FROM f
UNION ALL SELECT url, CAST(min(depth) - 1 AS INT), 'pending', min(page_id) FROM r WHERE url NOT IN (SELECT url FROM f) AND url NOT IN (SELECT url FROM r WHERE page_id % 3 = 1) GROUP BY url""",
    "visited_upsert": """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2 DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
    "errors_latest": """SELECT event_id AS id, event_type AS error, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM events ORDER BY floor(epoch(ts)) DESC, event_id DESC LIMIT 100""",
    "circuit_breaker": """WITH e AS (SELECT user_id, event_id, event_id % 7 = 0 AS ok, event_id % 3 <> 0 AS late FROM events),
g AS (SELECT *, (SELECT count(*) FROM e o WHERE o.ok AND o.user_id = e.user_id AND o.event_id <= e.event_id) AS run FROM e),
n AS (SELECT user_id, run, count(*) FILTER (late AND NOT ok) AS k FROM g GROUP BY ALL)
SELECT user_id, max(k) AS longest, max(k) >= 3 AS tripped FROM n GROUP BY user_id""",
    "in_flight": """SELECT user_id, event_id, sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS in_flight FROM events""",
    "crawl_bfs": """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 1 AS w FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, CAST(c_custkey % 2 AS INT) FROM customer UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 0 FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 1 FROM orders),
t(url, depth) AS (SELECT * FROM (VALUES ('r0', 0), ('r1', 0)) UNION SELECT e.dst, t.depth + e.w FROM t JOIN e ON t.url = e.src WHERE t.depth + e.w <= 3)
SELECT url, CAST(min(depth) AS INT) AS depth FROM t GROUP BY url""",
}

_HTML_EXT = "('', " + ", ".join(f"'{x}'" for x in predicates.HTML_EXTENSIONS) + ")"
_ASSET_EXT = "(" + ", ".join(f"'{x}'" for x in predicates.ASSET_EXTENSIONS) + ")"
_ENQUEUED = ORACLE_SQL["frontier_enqueue"].replace("WITH ", "", 1)

ORACLE_SQL |= {
    "probe_paths": f"""WITH b AS (SELECT unnest(string_split('{" ".join(sources.PROBE_BASES)}', ' ')) AS base, generate_subscripts(string_split('{" ".join(sources.PROBE_BASES)}', ' '), 1) AS i),
s(j, suffix) AS (VALUES (0, ''), (1, '/'), (2, '.php'), (3, '.html'), (4, '/index.php'), (5, '/index.html')),
o AS (SELECT unnest(string_split('{" ".join(sources.PROBE_OTHERS)}', ' ')) AS path, generate_subscripts(string_split('{" ".join(sources.PROBE_OTHERS)}', ' '), 1) AS j),
p AS (SELECT base || suffix AS path, i * 100 + j AS place FROM b, s WHERE j < 2 OR NOT (ends_with(base, '.php') OR ends_with(base, '.html')) UNION ALL SELECT path, 1000000 + j FROM o),
n AS (SELECT CAST(row_number() OVER (ORDER BY min(place)) - 1 AS INT) AS position, path FROM p GROUP BY path)
SELECT origin, position, origin || path AS url FROM n, (SELECT DISTINCT regexp_extract(url, '^[^:]+://[^/?#]*') AS origin FROM pages)""",
    "link_weights": f"""WITH {_PARTS}, {_LINKS}, n AS (SELECT *, page_id + position AS n FROM l), k AS (SELECT *, href || ['', '.html', '.PHP', '.css', '.js', '.png', '.unknown', '/'][n % 8 + 1] AS path, ['a', 'img', 'link', 'script', 'iframe', 'div'][n % 6 + 1] AS tag FROM n),
e AS (SELECT *, lower(coalesce(list_extract(regexp_extract_all(path, '[^/][.]([^./]+)$', 1), 1), '')) AS ext FROM k)
SELECT page_id, CAST(position AS INT) AS position, CAST(CASE WHEN n % 4 = 0 OR tag IN ('script', 'img') THEN 0 WHEN tag IN ('a', 'iframe') THEN 1 WHEN ext IN {_HTML_EXT} THEN 1 ELSE 0 END AS INT) AS link,
  CAST(CASE WHEN ext IN {_ASSET_EXT} THEN 0 ELSE 1 END AS INT) AS script, CAST(CASE WHEN ext IN {_HTML_EXT} THEN 1 ELSE 0 END AS INT) AS json FROM e""",
    "ignored_links": f"""WITH {_PARTS}, {_LINKS}, a2 AS (SELECT page_id, position, ['', 'mailto:', 'TEL:', 'javascript:', 'data:', 'blob:', 'about:', 'file:', 'ftp:', 'WS:', 'wss:', 'https:', ' javascript:', 'x-javascript:'][(page_id * 3 + position) % 14 + 1] || href AS address FROM l)
SELECT page_id, CAST(position AS INT) AS position, address, lower(split_part(address, ':', 1)) IN ('mailto', 'tel', 'javascript', 'data', 'blob', 'about', 'file', 'ftp', 'ws', 'wss') AND contains(address, ':') AS ignored FROM a2""",
    "content_kinds": """WITH b AS (SELECT 'page' AS of, page_id AS id, html AS body FROM pages UNION ALL SELECT 'document', doc_id, coalesce(text, '') FROM documents),
m AS (SELECT of, id, lower(left(body, 2048)) AS head, ['', 'html', 'css', 'js', 'json', 'png', 'html'][id % 7 + 1] AS mime, ['', 'html', 'css', 'mjs', 'json', 'png'][id % 6 + 1] AS ext FROM b)
SELECT of, id, CASE WHEN mime = 'html' OR (mime = '' AND ext = 'html') OR (mime <> 'css' AND regexp_matches(head, '<!doctype html|<html|<head|<body')) THEN 'html' WHEN 'css' IN (mime, ext) THEN 'css'
  WHEN mime = 'js' OR ext = 'mjs' THEN 'js' WHEN 'json' IN (mime, ext) THEN 'json' ELSE 'asset' END AS kind FROM m""",
    "percent_codec": """SELECT doc_id, md5(replace(replace(replace(url_encode(coalesce(text, '')), '%2F', '/'), '%3A', ':'), '%40', '@')) AS encoded, md5(coalesce(text, '')) AS decoded FROM documents""",
    "scope_filter": f"""WITH {_PARTS}, {_LINKS}, o AS (SELECT page_id, position, origin, CASE position % 3 WHEN 0 THEN 'http://CDN.example.org' || href WHEN 1 THEN 'ftp' || substr(origin, 5) || href ELSE origin || href END AS other FROM l)
SELECT page_id, CAST(position AS INT) AS position, other FROM o WHERE position % 3 <> 1 AND NOT contains(lower(other), 'th') AND (regexp_matches(lower(other), '/[a-m]') OR contains(lower(other), 'cdn'))""",
    "pattern_rules": f"""WITH {_PARTS}, {_LINKS}, t AS (SELECT page_id, href, origin || href AS url FROM l), w AS (SELECT DISTINCT regexp_extract(href, '^/([a-z]{{3,}})$', 1) AS w FROM t WHERE page_id % 10 = 0),
r AS (SELECT CASE WHEN length(w) % 2 = 0 THEN 'include' ELSE 'exclude' END AS option, '/' || left(w, 5) || '[A-Z]*$' AS pattern FROM w WHERE w <> ''
  UNION SELECT * FROM (VALUES ('exclude', '[0-9]{{3}}'), ('include', '(the|and)$'), ('include', '[.]NET/.*e?st')))
SELECT DISTINCT url, option, pattern FROM t, r WHERE regexp_matches(url, '(?i)' || pattern)""",
    "site_decisions": f"""WITH h AS ({ORACLE_SQL["detect_site_kind"].split("h AS (", 1)[1].split("),\nc AS", 1)[0]}), c AS (SELECT doc_id, html, lower(html) AS low, doc_id % 7 AS a, doc_id % 10 + CASE WHEN doc_id % 3 = 2 THEN 1 ELSE 0 END AS s,
  octet_length(encode(replace(regexp_replace(html, '<[^>]*(>|$)', '', 'g'), '>', ''))) AS v FROM h),
r AS (SELECT *, contains(low, 'data-reactroot') OR contains(low, 'svelte') AS r1, contains(low, 'onclick') AS r2, contains(low, 'fetch(') AND s > 0 AS r3, contains(low, 'load more') AS hint FROM c),
p AS (SELECT *, CASE WHEN r1 THEN 5 ELSE 0 END + CASE WHEN s >= 8 AND a <= 2 THEN 3 WHEN s >= 5 AND a <= 4 THEN 2 ELSE 0 END + CASE WHEN v < 250 AND s >= 4 THEN 2 ELSE 0 END + CASE WHEN r2 THEN 2 ELSE 0 END + CASE WHEN r3 THEN 2 ELSE 0 END + CASE WHEN s > 0 AND a < 2 AND v < 300 THEN 1 ELSE 0 END AS n FROM r)
SELECT doc_id, array_to_string(list_filter([CASE WHEN r1 THEN '{detect.REASONS[0]}' END, CASE WHEN s >= 8 AND a <= 2 THEN '{detect.REASONS[2]}' WHEN s >= 5 AND a <= 4 THEN '{detect.REASONS[3]}' END, CASE WHEN v < 250 AND s >= 4 THEN '{detect.REASONS[4]}' END,
  CASE WHEN r2 THEN '{detect.REASONS[6]}' END, CASE WHEN r3 THEN '{detect.REASONS[7]}' END, CASE WHEN s > 0 AND a < 2 AND v < 300 THEN '{detect.REASONS[8]}' END], lambda x: x IS NOT NULL), '; ') AS reasons,
  CASE doc_id % 4 WHEN 0 THEN doc_id % 2 = 0 OR hint OR n >= 2 OR s > 0 WHEN 1 THEN hint OR n >= 2 WHEN 2 THEN hint OR n >= 3 ELSE n >= 3 END AS auto, doc_id % 2 = 0 OR hint AS forced FROM p""",
    "crawl_frontier": f"""WITH {_PARTS}, {_LINKS}, d AS (SELECT origin || href AS url, href, page_id % 3 AS depth FROM l)
SELECT url, CAST(min(depth) + 1 AS INT) AS depth, 'pending' AS status FROM d WHERE depth < 2 AND NOT contains(lower(url), '/the') AND url NOT IN (SELECT url FROM d WHERE depth = 0 AND starts_with(href, '/t')) GROUP BY url""",
    "crawl_pages": f"""WITH RECURSIVE {_PARTS}, d AS (SELECT canonical AS url, min(page_id) AS page_id, arg_min(html, page_id) AS html, any_value(origin) AS origin FROM q GROUP BY canonical),
first AS (SELECT origin, min(url) AS first FROM d GROUP BY origin),
a AS (SELECT url, origin, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM d),
ends AS (SELECT DISTINCT origin, href, origin || href AS url, length(href) % 5 AS n FROM a),
edges AS (SELECT url AS src, origin || href AS dst, 1 AS w FROM a
  UNION ALL SELECT e.url, a.origin || a.href, 1 FROM ends e JOIN first f ON e.origin = f.origin JOIN a ON a.url = f.first WHERE n = 2
  UNION ALL SELECT e.url, d.url, 1 FROM ends e JOIN d ON e.origin = d.origin WHERE n = 3 AND page_id % 3 = 1),
walk(url, depth) AS (SELECT url, 0 FROM (SELECT first AS url FROM first UNION SELECT origin || '/robots.txt' FROM first UNION SELECT origin || '/sitemap.xml' FROM first UNION SELECT url FROM d WHERE page_id % 3 = 0)
  UNION SELECT dst, depth + w FROM walk JOIN edges ON walk.url = edges.src WHERE depth + w <= 2),
least AS (SELECT url, min(depth) AS depth FROM walk GROUP BY url),
known AS (SELECT url, -1 AS n, url AS final_url, 'html' AS kind FROM d UNION ALL SELECT origin || unnest(['/robots.txt', '/sitemap.xml']), -1, origin || unnest(['/robots.txt', '/sitemap.xml']), 'asset' FROM first
  UNION ALL SELECT e.url, n, CASE n WHEN 2 THEN first WHEN 3 THEN e.url END, CASE WHEN n IN (2, 3) THEN 'html' END FROM ends e JOIN first USING (origin) WHERE e.url NOT IN (SELECT url FROM d))
SELECT url, CAST(depth AS INT) AS depth, CASE n WHEN 0 THEN 'skipped' WHEN 1 THEN 'failed' WHEN 4 THEN 'failed' ELSE 'done' END AS status, CASE n WHEN 0 THEN 'HTTP 404' WHEN 1 THEN 'HTTP 503' WHEN 4 THEN 'Unknown fetch error' END AS reason, final_url, kind FROM least LEFT JOIN known USING (url)""",
    "rewrite_html": f"""WITH {_PARTS}, f AS (SELECT *, 'site/' || host || CASE WHEN path LIKE '%/' THEN path || 'index.html' WHEN NOT regexp_matches(path, '[^/][.][^./]+$') THEN path || '/index.html' ELSE path END AS file FROM q),
{_LINKS.replace("FROM q", "FROM f").replace("a AS (SELECT page_id, origin,", "a AS (SELECT page_id, origin, file, host,").replace("SELECT page_id, origin, unnest", "SELECT page_id, origin, file, host, unnest")},
u AS (SELECT DISTINCT page_id, href, string_split(file, '/')[:-2] AS here, string_split('site/' || host || href || '/index.html', '/') AS there FROM l),
w AS (SELECT page_id, href, coalesce(list_min(list_filter(range(1, len(here) + 1), lambda k: here[k] IS DISTINCT FROM there[k] OR k > len(there) - 1)), len(here) + 1) - 1 AS common, here, there FROM u),
n AS (SELECT page_id, href, CASE WHEN len(here) = common THEN './' ELSE repeat('../', len(here) - common) END || array_to_string(there[common + 1:], '/') AS new FROM w),
s AS (SELECT page_id, list('="' || href || '"' ORDER BY href) AS old, list('="' || new || '"' ORDER BY href) AS new FROM n GROUP BY page_id),
t AS (SELECT q.page_id, q.html, coalesce(old, []) AS old, coalesce(new, []) AS new FROM q LEFT JOIN s USING (page_id))
SELECT page_id AS key, md5(list_reduce(list_prepend(html, list_transform(range(1, len(old) + 1), lambda k: k::VARCHAR)), lambda x, k: replace(x, old[k::INT], new[k::INT]))) AS html FROM t""",
    "rewrite_css": """WITH w AS (SELECT doc_id, regexp_extract(coalesce(text, ''), '([a-z]+)', 1) AS w FROM documents)
SELECT doc_id, '/* url(no.png) */ @import "./c.css"; a{background:url("./i/' || doc_id || '")} b{src:url(''keep.woff'')}' AS css FROM w""",
    "url_map_assign": f"""WITH {_PARTS}, {_LINKS}, t AS (SELECT page_id, origin || href AS url, 'site/' || regexp_extract(origin, '://(.*)', 1) || href || '/index.html' AS path FROM l)
SELECT url, CASE WHEN bool_or(page_id % 2 = 0) THEN 'known' ELSE min(path) END AS file_path, CASE WHEN bool_or(page_id % 2 = 0) THEN 'html' ELSE 'pending' END AS kind FROM t GROUP BY url""",
    "state_counts": f"""WITH n AS (WITH {_ENQUEUED}) SELECT (SELECT greatest(count(*) - 20, 0) FROM n) AS pending, (SELECT count(DISTINCT user_id) FROM events) AS visited, (SELECT count(*) FROM events) AS errors""",
    "frontier_dequeue": f"""WITH n AS (WITH {_ENQUEUED}), k AS (SELECT *, row_number() OVER (ORDER BY depth, added_at, url) AS k FROM n)
SELECT url, depth, CASE WHEN k > 20 THEN 'pending' WHEN added_at % 2 = 0 THEN 'done' ELSE 'in_progress' END AS status, added_at FROM k""",
    "stagnation": """WITH g AS (SELECT user_id, event_id, event_id * 7 % 11 < 3 AS poor, lag(event_id * 7 % 11 < 3) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT user_id, min(event_id) AS stops_at FROM g WHERE poor AND before GROUP BY user_id""",
    "tapped_bodies": """SELECT user_id, event_id FROM (SELECT user_id, event_id, (SELECT count(*) FROM events o WHERE o.user_id = e.user_id AND o.event_id > e.event_id) AS later FROM events e) WHERE later < 40""",
    "network_idle": """WITH f AS (SELECT user_id, event_id, event_id * 37 AS ms, sum(CASE WHEN event_id % 3 = 0 THEN -2 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
g AS (SELECT *, (SELECT min(o.ms) FROM f o WHERE o.user_id = f.user_id AND o.event_id > f.event_id) AS later, (SELECT min(o.ms) FROM f o WHERE o.user_id = f.user_id) AS first FROM f)
SELECT user_id, min(ms) AS idle_from FROM g WHERE n <= 0 AND (later IS NULL OR later >= ms + 5000) AND (event_id % 5 > 2 OR ms >= first + 1200) GROUP BY user_id""",
    "json_requests": """WITH r AS (SELECT user_id AS page, event_id AS request_id, CASE WHEN event_id % 3 > 0 THEN 'http://h/' || event_type || ['/api/x', '/list?page=2', '/d.JSON', '/graphql?cursor=a', '/plain', ''][event_id % 6 + 1] ELSE 'http://h/p' || user_id END AS url FROM events),
s AS (SELECT *, CASE event_id6 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 2 WHEN 3 THEN 9 ELSE 0 END * (request_id % 3 > 0)::INT AS score FROM (SELECT *, request_id % 6 AS event_id6 FROM r)),
p AS (SELECT page, request_id, url, CAST(score AS INT) AS score, CAST(row_number() OVER (PARTITION BY page ORDER BY score DESC, request_id) AS INT) AS place FROM s) SELECT * FROM p WHERE place <= 25""",
}
