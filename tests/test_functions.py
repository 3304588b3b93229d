"""Literals of URL, path, extraction, detection and rewriting behaviour."""

import pytest
from pyspark.sql import functions as F

from webweft.functions import detect, extract, paths, predicates, rewrite, urls


def value(spark, column, **inputs):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in inputs.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("http://example.com/path", ("http", "example.com", 80, "/path", "", "")),
        ("https://example.com:8443/path", ("https", "example.com", 8443, "/path", "", "")),
        ("https://example.com/search?q=test&page=1#results", ("https", "example.com", 443, "/search", "q=test&page=1", "results")),
        ("http://example.com", ("http", "example.com", 80, "/", "", "")),
        ("http://example.com:abc/path", None),
        ("http://example.com:/path", None),
        ("http://example.com:70000/path", None),
        ("http://example.com:0/path", None),
        ("http://u:p@H.com/x", ("http", "h.com", 80, "/x", "", "")),
        ("http://[::1]:81/x", ("http", "[::1]", 81, "/x", "", "")),
        ("http://h?x=/y", ("http", "h", 80, "/y", "x=/y", "")),
        ("http://h/b#c?d", ("http", "h", 80, "/b", "d", "c?d")),
        ("", None),
        (None, None),
    ],
)
def test_parse(spark, text, expected):
    got = value(spark, urls.url_parse(F.col("u").cast("string")), u=text)
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize(("path", "expected"), [("/a/b/../c", "/a/c"), ("/a/./b/./c", "/a/b/c"), ("/a/b/c/../../d", "/a/d"), ("/", "/"), ("/a/", "/a/"), ("/..", "/"), ("/a//b", "/a/b"), ("/a/b/..", "/a")])
def test_normalize_path(spark, path, expected):
    assert value(spark, urls.normalize_path("p"), p=path) == expected


@pytest.mark.parametrize(
    ("reference", "expected"),
    [
        ("http://other.com/path", "http://other.com/path"),
        ("//cdn.example.com/file.js", "http://cdn.example.com/file.js"),
        ("/other/path.html", "http://example.com/other/path.html"),
        ("sibling.html", "http://example.com/dir/sibling.html"),
        ("../other/file.html", "http://example.com/other/file.html"),
        ("?query=value", "http://example.com/dir/page.html?query=value"),
        ("#section", "http://example.com/dir/page.html"),
        ("", "http://example.com/dir/page.html"),
    ],
)
def test_resolve(spark, reference, expected):
    assert value(spark, urls.resolve_key("b", "r"), b="http://example.com/dir/page.html", r=reference) == expected


def test_small_url_functions(spark):
    assert value(spark, F.transform(F.array(*map(F.lit, ("mailto:a@b.c", "MAILTO:x", "tel:+1", "JAVASCRIPT:void(0)", "data:image/png;base64,a", "", "http://example.com", "/path", "rel"))), urls.should_ignore)) == [True] * 6 + [False] * 3
    assert value(spark, F.transform(F.array(*map(F.lit, ("hello%20world", "%2F", "no-encoding", "100%", "a+b", "%C3%A9"))), urls.percent_decode)) == ["hello world", "/", "no-encoding", "100%", "a+b", "é"]
    assert value(spark, urls.percent_encode("x"), x="a b/é*~") == "a%20b/%C3%A9%2A~"
    assert value(spark, urls.with_page(urls.url_parse("u"), F.lit(3)), u="http://h/x?a=1&P=2") == "http://h/x?a=1&P=3"
    assert value(spark, urls.with_page(urls.url_parse("u"), F.lit(3)), u="http://h/x") == "http://h/x?page=3"


@pytest.mark.parametrize(("url", "path"), [("http://example.com/", "site/example.com/index.html"), ("http://example.com/about", "site/example.com/about/index.html"), ("http://example.com/blog/", "site/example.com/blog/index.html"), ("http://example.com/styles/main.css", "site/example.com/styles/main.css"), ("http://example.com/index.php", "site/example.com/index.html"), ("http://example.com:8080/page.html", "site/example.com__p_8080/page.html")])
def test_local_path(spark, url, path):
    assert value(spark, paths.local_path(urls.url_parse("u")), u=url) == path


@pytest.mark.parametrize(("a", "b", "expected"), [("site/index.html", "site/style.css", "./style.css"), ("site/index.html", "site/css/style.css", "./css/style.css"), ("site/blog/post.html", "site/style.css", "../style.css"), ("a/b/c.html", "x/y.html", "../../x/y.html")])
def test_relative_path(spark, a, b, expected):
    assert value(spark, paths.relative_path("a", "b"), a=a, b=b) == expected


def test_html_links(spark):
    html = """<!-- <a href="/no"> --><a href="/page1">x</a><IMG src=a.png srcset="s.jpg 1x, l.jpg 2x"><link rel="StyleSheet" href='c.css'><script src="x.js">"<a href='/no'>"</script>
    <div data-url="/api" onclick="go('/run')"></div><meta http-equiv="refresh" content="0; url=/new"><iframe data-src="/f"></iframe>"""
    got = [(x["url"], x["tag"], x["is_stylesheet"], x["is_script"]) for x in value(spark, extract.html_links("h"), h=html)]
    assert got == [("/page1", "a", False, False), ("a.png", "img", False, False), ("s.jpg", "img", False, False), ("l.jpg", "img", False, False), ("c.css", "link", True, False), ("x.js", "script", False, True), ("/api", "div", False, False), ("/run", "div", False, False), ("/new", "meta", False, False), ("/f", "iframe", False, False)]
    assert value(spark, extract.base_href("h"), h='<base target=x><base href=""><base href="/b/">') == "/b/"
    assert value(spark, extract.charset("h"), h='<meta charset="utf-8">') == "utf-8"
    assert value(spark, extract.html_links(F.col("h").cast("string")), h=None) is None


def test_css_js_robots(spark):
    css = """/* url(no) */ @import url("a.css"); @import 'b.css' screen; x{background:url( c.png )} y{src:url("d e.woff")} z{x:url(data:a)}"""
    assert [(r["url"], r["is_import"]) for r in value(spark, extract.css_refs("c"), c=css)] == [("a.css", True), ("b.css", True), ("c.png", False), ("d e.woff", False)]
    js = """import a from "./a.js"; import('/b.js'); require("./c.js"); fetch("/d"); new Worker('/e.js'); location.href = "/f"; router.push("/g"); x={path: "/h"}; fetch("mailto:x")"""
    assert value(spark, extract.js_urls("j"), j=js) == ["./a.js", "/b.js", "./c.js", "/d", "/e.js", "/f", "/g", "/h"]
    robots = "Sitemap: http://x/a.xml\n# Sitemap: http://x/b.xml\nsitemap:http://x/c.xml\nDisallow: /admin/\nDisallow: /private/*.php$\nAllow: /api/public\nAllow: /\n"
    assert value(spark, extract.robots_sitemaps("r"), r=robots) == ["http://x/a.xml", "http://x/c.xml"]
    assert value(spark, extract.robots_hints("r"), r=robots) == ["/admin/", "/private/", "/api/public"]
    assert value(spark, extract.sitemap_locs("x"), x="<loc> http://x/?a=1&amp;b=2 </loc><LOC>http://y</LOC>") == ["http://x/?a=1&b=2", "http://y"]
    assert value(spark, extract.page_numbers("h", 50), h='<a data-page="3"><a data-page=\'1\'><a data-page-number="9999">') == [1, 3]


def test_detect_and_rewrite(spark):
    shell = "<div id=\"__next\"></div>" + "<script></script>" * 8
    assert value(spark, detect.detect("h"), h=shell)["kind"] == "dynamic"
    assert value(spark, detect.detect("h"), h="<p>plain</p>")["kind"] == "static"
    mapping = F.create_map(F.lit("a.png"), F.lit("./l.png"), F.lit("b.css"), F.lit("./b.css"))
    assert value(spark, rewrite.css_rewrite(F.lit("@import 'b.css' print; x{y:url(a.png)} /* url(a.png) */"), mapping)) == '@import "./b.css"; x{y:url("./l.png")} /* url(a.png) */'
    pairs = F.array(F.struct(F.lit("/a").alias("old"), F.lit("./a.html").alias("new")), F.struct(F.lit("/a/b").alias("old"), F.lit("./b.html").alias("new")))
    assert value(spark, rewrite.html_rewrite(F.lit("<a href=\"/a\"><a href='/a/b'>"), pairs)) == "<a href=\"./a.html\"><a href='./b.html'>"
    assert value(spark, rewrite.srcset_rewrite(F.lit("a.png 1x, c.png"), mapping)) == "./l.png 1x, c.png"


def test_rules(spark):
    allowed = lambda u, i, e: value(spark, predicates.url_allowed(F.lit(u), i, e))
    assert allowed("http://x/Blog/1", ["/blog/"], ["admin"]) and not allowed("http://x/blog/admin", ["/blog/"], ["admin"]) and not allowed("", [], [])
    assert [predicates.normalize_alias(a) for a in (" HTTP://Cdn.x:80/p ", "a.b:1", "[::1]:2")] == ["cdn.x", "a.b", "[::1]"]
    kind = lambda m, p, b: value(spark, predicates.content_kind(F.lit(m), F.lit(p), F.lit(b)))
    assert [kind("text/html", "/", ""), kind("", "/x.css", ""), kind("application/json", "/", ""), kind("", "/a.mjs", ""), kind("image/png", "/", ""), kind("", "/x", "<HTML>")] == ["html", "css", "json", "js", "asset", "html"]
