"""The crawl over pages, its versioned state, prefix scans and the tree builder, on small literal cases."""

import html.parser
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webweft.functions import dom
from webweft.operators import patterns, scan, snapshots
from webweft.operators.shared import new_folder
from webweft.plans import site_crawl
from webweft.plans.site_crawl import Rules

RESPONSES = "url string, status_code int, content_type string, final_url string, body string, error string"
SEED = "http://h.x/"


def page(url, body, status=200, kind="text/html", final=None, error=""):
    return (url, status, kind, final or url, body, error)


def site():
    return [
        page(SEED, """<base href="/d/"><a href="a?x=1&amp;y=2#f">a</a><IMG SRC='i.png'><a href=http://other.x/>o</a><!-- <a href="/no">--><script>fetch('/api/v')</script>
          <style>b{background:url(s.png)}</style><p style="background:url('t.png')" onclick="go('/h')"><link rel=stylesheet href="/c.css"><a href="mailto:a@b"><i data-page="1"></i><i data-page='2'></i>"""),
        page("http://h.x/d/a?x=1&y=2", "<p>deep <a href=/end><a href='/moved'><a href='/gone'><a href='/down'><a href=/private/x>"),
        page("http://h.x/c.css", "@import 'more.css'; a{b:url(/u.png)}", kind="text/css"),
        page("http://h.x/more.css", "", kind="text/css"),
        page("http://h.x/api/v", '{"items": [{"url": "/j/1"}], "next": "/api/v?page=2", "page": 1, "total_pages": 3}', kind="application/json"),
        page("http://h.x/moved", "<a href=/never>", final="http://other.x/z"),
        page("http://h.x/end", "<a href=/too-deep>"),
        page("http://h.x/gone", "", status=404),
        page("http://h.x/down", "", status=500, error="timeout"),
        page("http://h.x/robots.txt", "Sitemap: /maps/sitemap.xml\nAllow: /hint", kind="text/plain"),
        page("http://h.x/maps/sitemap.xml", "<urlset><loc>/from-map?a=1&amp;b</loc></urlset>", kind="text/xml"),
        page("http://h.x/from-map?a=1&b", "<a href=/end>", final="http://h.x/From-Map"),
    ]


@pytest.fixture(scope="module")
def responses(spark):
    return spark.createDataFrame(site(), RESPONSES)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


RULES = Rules(max_depth=2, exclude=("/PRIVATE/",))


@pytest.fixture(scope="module")
def crawled(spark, responses):
    seeds = spark.createDataFrame([(SEED,), ("http://h.x/robots.txt",)], "url string")
    return site_crawl.crawl(spark, seeds, responses, RULES)


def test_crawl_follows_every_kind_of_link(crawled):
    found = {r["url"]: (r["depth"], r["status"], r["reason"]) for r in site_crawl.frontier(crawled).collect()}
    lost = "Unknown fetch error"
    assert found == {
        SEED: (0, "done", None),
        "http://h.x/robots.txt": (0, "done", None),
        "http://h.x/maps/sitemap.xml": (0, "done", None),
        "http://h.x/from-map?a=1&b": (0, "done", None),
        "http://h.x/d/a?x=1&y=2": (1, "done", None),
        "http://h.x/d/i.png": (0, "failed", lost),
        "http://h.x/d/s.png": (0, "failed", lost),
        "http://h.x/d/t.png": (0, "failed", lost),
        "http://h.x/h": (1, "failed", lost),
        "http://h.x/c.css": (0, "done", None),
        "http://h.x/more.css": (0, "done", None),
        "http://h.x/u.png": (0, "failed", lost),
        "http://h.x/api/v": (1, "done", None),
        "http://h.x/j/1": (2, "failed", lost),
        "http://h.x/api/v?page=2": (1, "failed", lost),
        "http://h.x/api/v?page=3": (1, "failed", lost),
        "http://h.x/?page=2": (1, "failed", lost),
        "http://h.x/end": (1, "done", None),
        "http://h.x/too-deep": (2, "failed", lost),
        "http://h.x/moved": (2, "skipped", "out of scope"),
        "http://h.x/gone": (2, "skipped", "HTTP 404"),
        "http://h.x/down": (2, "failed", "timeout"),
    }


def test_crawl_state_tables(crawled):
    mapped = {r["url"]: (r["file_path"], r["kind"]) for r in site_crawl.url_map(crawled).collect()}
    assert mapped["http://h.x/From-Map"] == ("site/h.x/From-Map/index.html", "html")
    assert mapped["http://h.x/from-map?a=1&b"] == ("site/h.x/From-Map/index.html", "redirect")
    assert mapped["http://h.x/c.css"][1] == "css" and mapped["http://h.x/api/v"][1] == "json" and mapped["http://h.x/robots.txt"][1] == "asset"
    errors = crawled.read("errors").orderBy("id").collect()
    assert [r["id"] for r in errors] == list(range(1, len(errors) + 1)) and len(errors) == 11
    assert all(a["at"] <= b["at"] for a, b in zip(errors, errors[1:]))
    assert [r["error"] for r in errors if r["url"] == "http://h.x/down"] == ["timeout"]
    visited = {r["url"]: r for r in crawled.read("visited").collect()}
    assert visited["http://h.x/from-map?a=1&b"]["final_url"] == "http://h.x/From-Map" and visited[SEED]["status_code"] == 200


def test_crawl_stops_and_goes_on(spark, responses, crawled):
    """Stopped after two steps, killed within the third, then gone on with: the same as the unbroken run."""
    seeds = spark.createDataFrame([(SEED,), ("http://h.x/robots.txt",)], "url string")
    root = new_folder(spark, "test-crawl")
    first = site_crawl.crawl(spark, seeds, responses, RULES, root, most_steps=2)
    before = rows(site_crawl.frontier(first), "url", "depth", "status")

    class Killed(Exception):
        pass

    class Dying(snapshots.Snapshots):
        def write(self, table, found):
            if table == "url_map":
                raise Killed
            return super().write(table, found)

    with pytest.raises(Killed):
        site_crawl.step(Dying(spark, root, site_crawl.SCHEMAS), responses, RULES)
    again = site_crawl.start(spark, seeds, RULES, root)
    assert again.current() == 2 and rows(site_crawl.frontier(again), "url", "depth", "status") == before
    assert again.expire() and rows(site_crawl.frontier(again), "url", "depth", "status") == before
    whole = site_crawl.crawl(spark, seeds, responses, RULES, root)
    for table in ("processed", "visited", "errors", "url_map"):
        columns = [c for c in whole.read(table).columns]
        assert rows(whole.read(table), *columns) == rows(crawled.read(table), *columns)
    assert whole.roll_back(2) == whole.current() and rows(site_crawl.frontier(whole), "url", "depth", "status") == before


def test_versions(spark):
    s = snapshots.Snapshots(spark, new_folder(spark, "test-versions"), {"a": "x int", "b": "y string"})
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "x int")
    assert s.current() is None and s.read("a").count() == 0
    assert s.commit({"a": s.write("a", one(1, 2))}) == 0
    s.write("a", one(99))  # never committed
    assert s.commit({"a": s.write("a", one(3))}, note="more") == 1
    assert s.commit({}, {"a": s.write("a", one(7))}) == 2
    assert [rows(s.read("a", v), "x") for v in (0, 1, 2)] == [[(1,), (2,)], [(1,), (2,), (3,)], [(7,)]]
    assert s.roll_back(1) == 3 and rows(s.read("a"), "x") == [(1,), (2,), (3,)] and s.read("b").count() == 0
    assert len(s.expire()) == 2 and rows(s.read("a"), "x") == [(1,), (2,), (3,)] and s.expire() == []
    with pytest.raises(ValueError):
        s.roll_back(17)


def test_prefix_scans_of_one_key(spark):
    """Equal to the window that sees all rows, with one key and with many, and nowhere a window without partition."""
    rng = random.Random(3)
    data = [("hot" if i % 10 else f"k{i % 70}", i // 2, rng.randint(-3, 5) if i % 9 else None) for i in range(3000)] + [(None, 5, 2), (None, 6, 2)]
    df = spark.createDataFrame(data, "k string, at long, v long").withColumn("id", F.monotonically_increasing_id())
    want = F.sum(F.coalesce("v", F.lit(0))).over(Window.partitionBy("k").orderBy("at", "id"))
    got = scan.running_sums(df, ["k"], ["at", "id"], {"s": "v"})
    assert rows(got, "id", "s") == rows(df.withColumn("s", want), "id", "s")
    numbers = scan.numbered(df, ["at", "id"], "n")
    assert [r["n"] for r in numbers.orderBy("at", "id").collect()] == list(range(1, 3003))
    plan = numbers._jdf.queryExecution().executedPlan().toString()
    assert "Window [row_number" not in plan
    queue = spark.createDataFrame([("b", 5, 1), ("a", 5, 2), ("c", 1, 3)], "url string, not_before long, seq long")
    assert rows(scan.retry_order(queue), "place", "url") == [(1, "c"), (2, "b"), (3, "a")]
    assert scan.numbered(queue.limit(0), ["seq"], "n").count() == 0


class Second(html.parser.HTMLParser):
    """Another parser's start tags."""

    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        first = {}
        for name, value in attrs:
            first.setdefault(name, value or "")
        self.found.append((tag, list(first.items())))


BROKEN = [
    "<p>a<p>b<ul><li>c<li>d</ul>e", "<table><tr><td>1<td>2<tr><td>3</table><p>z", "<div><span></div></span><a href=q>", "<a href=x class=1 href=y>",
    "<a\nhref\n=\n'm'>", '<a title="5" tall" href=z>q</a>', "<script>'<a href=3>'</script><a href=4>", "<textarea>5</textarea><b>", "<!--x--><a href=1><!DOCTYPE q><?pi <b>?><i>",
    '<a href="&eacute;&amp;x&lt;&#233;&#x41;">', "<br/><img src=a/><hr>", "</p><b></b></i><u>", "a < b <c d='>'>", "<dl><dt>x<dd>y<dt>z</dl>", "<select><option>1<option selected>2</select>", "<STYLE>a>b{}</STYLE><Em CLASS=Q>",
]


@pytest.mark.parametrize("text", BROKEN)
def test_tree_against_a_second_parser(text):
    other = Second()
    other.feed(text)
    assert [(e.tag, e.attributes) for e in dom.tree(text)] == other.found


def test_tree_shapes():
    shape = lambda h: [(e.tag, e.parent, "".join(e.text)) for e in dom.tree(h)]
    assert shape("<p>a<p>b<ul><li>c<li>d</ul>e") == [("p", -1, "a"), ("p", -1, "b"), ("ul", -1, ""), ("li", 2, "c"), ("li", 2, "d")]
    assert shape("<table><tr><td>1<table><td>2</table><td>3</table>") == [("table", -1, ""), ("tr", 0, ""), ("td", 1, "1"), ("table", 2, ""), ("td", 3, "2"), ("td", 1, "3")]
    assert shape("<div><p>x</div>y<b>z") == [("div", -1, ""), ("p", 0, "x"), ("b", -1, "z")]
    assert shape("<title>&amp;<b></title><script>&amp;</script>") == [("title", -1, "&<b>"), ("script", -1, "&amp;")]
    values = lambda h: [v for e in dom.tree(h) for _, v in e.attributes]
    assert values("<a href=/x?a=1&copy=2&lt;b&notit;&amp&quot>") == ["/x?a=1&copy=2<b&notit;&\""]
    assert values('<a x="unclosed><b y=1>') == [] and values("<a b=1") == [] and dom.tree("") == dom.tree(None) == []
    assert len(dom.tree("<b>" * 5000)) == 5000 and dom.tree("<b>" * 5000)[-1].depth == 4999


def test_elements_links_and_sql(spark):
    html = '<meta http-equiv=Refresh content="0; url=/new"><a href="/p" data-url="/q"><img srcset="s.jpg 1x, l.jpg 2x" src="i.png"><div onclick="open(\'/go\')" hx-get="/h"><link rel="preload Stylesheet" href="c.css"><script src="s.js"></script><base href=""><base href="/b/"><meta name=x content="url=/no">'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string")
    found = dom.elements(pages)
    got = [tuple(r) for r in dom.links(found).orderBy("node", "rule", "nth").select("tag", "attribute", "url", "is_stylesheet", "is_script").collect()]
    assert got == [
        ("meta", "content", "/new", False, False), ("a", "href", "/p", False, False), ("a", "data-url", "/q", False, False), ("img", "src", "i.png", False, False), ("img", "srcset", "s.jpg", False, False), ("img", "srcset", "l.jpg", False, False),
        ("div", "hx-get", "/h", False, False), ("div", "onclick", "/go", False, False), ("link", "href", "c.css", True, False), ("script", "src", "s.js", False, True),
    ]
    assert rows(dom.base_href(found, "id"), "id", "base") == [(1, "/b/")]
    spark.udtf.register("html_elements", dom.HtmlElements)
    pages.createOrReplaceTempView("dom_pages")
    named = spark.sql("SELECT id, e.tag, element_at(e.values, 1) AS v FROM dom_pages, LATERAL html_elements(html) AS e WHERE e.tag = 'a'")
    assert rows(named, "id", "tag", "v") == [(1, "a", "/p")]
    with pytest.raises(ValueError):
        dom.elements(pages.withColumn("depth", F.lit(1)))


@pytest.mark.parametrize(
    "pattern, sure",
    [
        ("/admin", ["/admin"]), ("^https?://X\\.y/A+b", ["http", "://x.y/a", "b"]), ("a|b", []), ("(a|b)cd[e]f?g", ["cd", "g"]), ("abc*d", ["ab", "d"]), ("ab{2,3}c", ["a", "c"]), ("\\d+page", ["page"]), ("(?x)a b", []),
        ("[]a]bcd", ["bcd"]), ("[^]a]bcd", ["bcd"]), ("x.y", ["x", "y"]), ("\\x41bc", []), ("", []), ("ab+?c", ["ab", "c"]), ("\\Qa.b\\E", []), ("(a[)]b)cde", ["cde"]),
    ],
)
def test_literals_of_patterns(pattern, sure):
    assert patterns.literals(pattern) == sure


def test_patterns_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcde/.0", k=n))
    addresses = [f"http://h{i % 7}.x/{word(rng.randint(0, 14))}{'Q' * (i % 3)}" for i in range(400)]
    rules = [(rng.choice(("include", "exclude")), p) for p in {word(3).replace(".", "[.]") for _ in range(60)} | {f"{word(4)}?x*q+$" for _ in range(9)} | {"^https?://h3", "h[12]\\.x/a", "ab|cd", "[0-9]{2}", "q{2}$", "zzzz"}]
    urls = spark.createDataFrame([(i, u) for i, u in enumerate(addresses)], "id int, url string")
    table = spark.createDataFrame([*rules, ("include", "")], "option string, pattern string")
    import re

    want = {(u, o, p) for u in set(addresses) for o, p in rules if re.search(p, u, re.I)}
    assert rows(patterns.matches(urls, table), "url", "option", "pattern") == sorted(want, key=str)
    known = patterns.indexed(table)
    assert patterns.candidates(urls, known).count() < len(set(addresses)) * known.filter("size(grams) > 0").count() / 4
    ok = [i for i, u in enumerate(addresses) if any(o == "include" and re.search(p, u, re.I) for o, p in rules) and not any(o == "exclude" and re.search(p, u, re.I) for o, p in rules)]
    assert [r["id"] for r in patterns.allowed(urls, table).orderBy("id").collect()] == ok
    only = table.filter("option = 'exclude'")
    assert patterns.allowed(urls, only).count() == sum(not any(o == "exclude" and re.search(p, u, re.I) for o, p in rules) for u in addresses)
    with pytest.raises(ValueError, match='exclude: "[(]a"'):
        patterns.matches(urls, spark.createDataFrame([("exclude", "(a")], "option string, pattern string"))
    assert patterns.matches(urls.limit(0), table).count() == 0
