"""Rewriting, rendering decisions, links of every kind of document, sources, state and events, on small cases."""

import pytest
from pyspark.sql import functions as F

from webweft.functions import extract, render, rewrite, urls
from webweft.operators import events, links, state
from webweft.plans.crawl import crawl_depths
from webweft.sources import pages as sources


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("html", "mapping", "expected"),
    [
        ('<img data-src="images/photo.jpg">', {"images/photo.jpg": "./assets/photo.jpg"}, '<img data-src="./assets/photo.jpg">'),
        ('<img data-srcset="a.jpg 1x, b.jpg 2x">', {"a.jpg": "./img/a.jpg", "b.jpg": "./img/b.jpg"}, '<img data-srcset="./img/a.jpg 1x, ./img/b.jpg 2x">'),
        ("<div style=\"background:url('/images/bg.png')\"></div>", {"/images/bg.png": "./assets/bg.png"}, '<div style="background:url(&quot;./assets/bg.png&quot;)"></div>'),
        ("<style>.hero{background:url('/img/hero.jpg');}</style>", {"/img/hero.jpg": "./media/hero.jpg"}, '<style>.hero{background:url("./media/hero.jpg");}</style>'),
        ('<meta http-equiv="refresh" content="0; url=/new-page">', {"/new-page": "./new-page/index.html"}, '<meta http-equiv="refresh" content="0; url=./new-page/index.html">'),
        ("<meta http-equiv=refresh content=\"1; URL='/n#f'; x\">", {"/n": "./n.html"}, "<meta http-equiv=refresh content=\"1; URL='./n.html#f'; x\">"),
        ('<meta name="x" content="/a"><a href="/a#top">t</a>', {"/a": "./a.html"}, '<meta name="x" content="/a"><a href="./a.html#top">t</a>'),
        ('<a data-url="/a" href="/b">/b</a>', {"/a": "x", "/b": "y"}, '<a data-url="/a" href="y">/b</a>'),
        ("<p style='color:red'>none</p>", {"z": "y"}, "<p style='color:red'>none</p>"),
    ],
)
def test_page_rewrite(spark, html, mapping, expected):
    known = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    assert value(spark, rewrite.page_rewrite(F.lit(html), known)) == expected


def test_handlers_and_scripts(spark):
    assert value(spark, extract.handler_urls(F.lit("go('HTTPS://x/y'); a('/b\\\\'); c(\"./d\")"))) == ["HTTPS://x/y", "./d"]
    html = '<script type="m"src=x>import "./no"</script><script>import "./yes"</script>'
    assert value(spark, extract.inline_js_urls(F.lit(html))) == ["./yes"]


def test_render(spark):
    assert [render.interaction_budget(*x) for x in ((8, True), (8, False), (1, True), (0, True), (-1, False))] == [6, 1, 2, 0, 0]
    assert [render.json_body_limit(*x) for x in ((50, False, 0), (300, True, 0), (10, False, 0), (300, False, 2))] == [25, 120, 16, 24]
    assert render.site_mode("auto", None)[0] == "static" and render.site_mode("dynamic", None)[1] == 999
    json = lambda *x: value(spark, render.is_json_response(*map(F.lit, x)))
    assert json("application/LD+json", "", "") and json("", "/GraphQL", "") and json("", "/api/x", "XHR") and not json("", "/api/x", "script")
    seen = lambda u: value(spark, render.discovered_url(F.lit("http://h/a/"), F.lit(u)))
    assert [seen(u) for u in ("b", "b?x=", "mailto:a", "", "../c#d")] == ["http://h/a/b", None, None, None, "http://h/c"]
    assert value(spark, render.is_sitemap_body(F.lit("<?xml?><URLSET>"))) and value(spark, render.is_sitemap_path(F.lit("/a/Sitemap.xml")))
    assert value(spark, render.is_retryable(F.lit("timeout"))) and not value(spark, render.is_retryable(F.lit("tls")))


def test_links_of_every_kind(spark):
    rows = [
        ("http://h/a/", "html", 0, '<base href="/x/"><a href="p">p</a><img src="i.png"><link rel=stylesheet href=s.css><style>a{b:url(u.gif)}</style><script>fetch("/api/v");</script><i data-page="3"></i><i data-page="1"></i>'),
        ("http://h/s.css", "css", 1, "@import 'b.css'; a{b:url(c.png)}"),
        ("http://h/m.js", "js", 1, "import './n.js'; location.href = '/go';"),
        ("http://h/asset", "asset", 1, "url(no.png)"),
    ]
    documents = spark.createDataFrame(rows, "url string, kind string, depth int, body string")
    found = links.document_links(documents)
    got = {(r["href"], r["origin"], r["weight"]) for r in found.collect()}
    assert got == {("p", "element", 1), ("i.png", "element", 0), ("s.css", "element", 0), ("u.gif", "style", 0), ("/api/v", "script", 1), ("http://h/x/?page=3", "paging", 1), ("b.css", "style", 0), ("c.png", "style", 0), ("./n.js", "script", 0), ("/go", "script", 1)}
    body = '{"items": ["/i.png", "/p/1"], "next": "/l?page=2", "page": 1, "total_pages": 3}'
    json = links.json_links(spark.createDataFrame([("http://h/l", "json", 1, body)], documents.schema))
    assert {(r["href"], r["weight"]) for r in json.collect()} >= {("/i.png", 0), ("/p/1", 1), ("http://h/l?page=2", 0), ("http://h/l?page=3", 0)}
    frontier = spark.createDataFrame([("http://h/x/p", 5, "done", 1)], state.FRONTIER)
    visited = spark.createDataFrame([("http://h/x/s.css",)], "url string")
    extra = spark.createDataFrame([("http://h/", "mailto:x", 0, 0), ("http://h/", "http://other/", 0, 0), ("http://h/", "ftp://h/", 0, 0)], "base string, href string, depth int, weight int")
    every = found.select("base", "href", "depth", "weight").unionByName(extra)
    new = links.enqueue_links(every, frontier, visited, "http://h/", 1).filter("status = 'pending'")
    assert {(r["url"], r["depth"]) for r in new.collect()} == {("http://h/x/i.png", 0), ("http://h/x/u.gif", 0), ("http://h/api/v", 1), ("http://h/x/?page=3", 1), ("http://h/b.css", 1), ("http://h/c.png", 1), ("http://h/n.js", 1)}


def test_rewritten_pages(spark):
    pages = spark.createDataFrame([(1, "http://h/a/", "site/h/a/index.html", '<a href="b.html#x">b</a><a href="/c">c</a><a href="mailto:x">m</a>'), (2, "http://h/d", "site/h/d/index.html", "none")], "key int, url string, file_path string, html string")
    known = spark.createDataFrame([("http://h/c", "site/h/other.html", "html")], "url string, file_path string, kind string")
    html, whole = links.rewritten_pages(pages, known)
    assert {r["key"]: r["html"] for r in html.collect()} == {1: '<a href="./b.html#x">b</a><a href="../other.html">c</a><a href="mailto:x">m</a>', 2: "none"}
    assert {tuple(r) for r in whole.collect()} == {("http://h/c", "site/h/other.html", "html"), ("http://h/a/b.html", "site/h/a/b.html", "pending")}


def test_sources(spark):
    headers = sources.parse_headers(F.array(*map(F.lit, ("HTTP/1.1 200 OK", "Content-Type:  text/html\r\n", "X-A: 1", "x-a: 2:3"))))
    assert value(spark, headers) == {"content-type": "text/html", "x-a": "2:3"}
    seeds = sources.extra_seeds(spark.createDataFrame([("/b",), ("http://o/./c#d",), ("",), ("/a/../b",)], "address string"), "http://h/a")
    assert {r["url"] for r in seeds.collect()} == {"http://h/b", "http://o/c"}
    assert sources.probe_paths(spark).count() == 575
    pages = spark.createDataFrame([("u", "old"), ("v", "old")], "url string, html string")
    renders = spark.createDataFrame([("u", "new", None), ("v", "bad", "timeout")], "url string, html string, error string")
    assert {tuple(r) for r in sources.with_renders(pages, renders).collect()} == {("u", "new"), ("v", "old")}
    kept = spark.createDataFrame([("p", "a", 1), ("p", "b", 2)], "path string, body string, seq int")
    assert [(r["path"], bytes(r["content"])) for r in sources.files(kept).collect()] == [("p", b"b")]


def test_state(spark):
    errors = spark.createDataFrame([(4, "u", "e", 1)], "id long, url string, error string, at long")
    more = spark.createDataFrame([("b", "x", 3), ("a", "y", 2)], "url string, error string, at long")
    assert sorted((r["id"], r["url"]) for r in state.add_errors(errors, more).collect()) == [(4, "u"), (5, "a"), (6, "b")]
    assert [r["id"] for r in state.lookup(errors, spark.createDataFrame([("u",), ("z",)], "url string")).orderBy("url").collect()] == [4, None]
    assert state.cleared(errors).count() == 0 and state.cleared(errors).columns == errors.columns


def test_event_fold(spark):
    rows = [(1, 0, 0, "a", "requested", "XHR", ""), (1, 5, 1, "a", "requested", "XHR", ""), (1, 6, 2, "w", "requested", "WebSocket", ""), (1, 7, 3, "a", "finished", "XHR", "x/json"), (1, 8, 4, "a", "failed", "XHR", ""), (1, 9, 5, "z", "finished", "XHR", ""), (1, 9, 6, "s", "requested", "XHR", "text/event-stream")]
    folded = events.changes(spark.createDataFrame(rows, "page int, ts long, seq long, request_id string, method string, type string, mime string"))
    assert sorted((r["request_id"], r["change"], r["ts"]) for r in folded.collect()) == [("a", -1, 7), ("a", 1, 0)]
    found = spark.createDataFrame([(1, "c", 1), (1, "a", 2), (1, "c", 3), (1, "b", 4)], "page int, url string, seq int")
    assert events.discovered(found, "page", "url", "seq", 2).first()["urls"] == ["a", "c"]


def test_crawl_of_nothing_and_of_circles(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("b", "a", 0), ("b", "c", 1), ("c", "d", 0), ("d", "e", 1), ("a", "c", 1)], "src string, dst string, weight int")
    seeds = spark.createDataFrame([("a",)], "url string")
    depths = lambda n: {r["url"]: r["depth"] for r in crawl_depths(seeds, edges, n).collect()}
    assert depths(0) == {"a": 0, "b": 0} and depths(1) == {"a": 0, "b": 0, "c": 1, "d": 1} and depths(9)["e"] == 2
    assert crawl_depths(seeds.limit(0), edges, 3).count() == 0


def test_link_stream(spark, tmp_path):
    from webweft.streaming.pages import link_stream

    page = spark.createDataFrame([("http://h/a#x", '<a href="b">b</a>'), ("http://h/a", '<a href="b">b</a>')], "url string, html string")
    page.withColumn("ts", F.timestamp_seconds(F.lit(1000))).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, html string, ts timestamp").parquet(str(tmp_path / "in"))
    query = link_stream(stream).writeStream.format("memory").queryName("links_seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(60)
    assert [tuple(r)[::2] for r in spark.table("links_seen").collect()] == [("http://h/a", "http://h/b")]
