"""Document to URL functions: HTML, CSS, JavaScript, robots.txt and sitemaps, as array Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import likely_url
from .text import ascii_lower, col, groups, let, trim_space
from .urls import should_ignore

#: Attributes with a URL, by tag.
TAG_ATTRIBUTES = {
    "a": ("href",),
    "img": ("src", "srcset", "data-src", "data-srcset", "data-original", "data-lazy-src"),
    "script": ("src",),
    "link": ("href",),
    "source": ("src", "srcset", "data-src", "data-srcset"),
    "video": ("src", "poster"),
    "audio": ("src",),
    "iframe": ("src", "data-src"),
    "object": ("data",),
    "embed": ("src",),
    "form": ("action",),
    "area": ("href",),
}
#: Attributes that hold a URL on any tag.
ANY_TAG_ATTRIBUTES = ("data-href", "data-url", "data-link", "data-endpoint", "data-action-url", "data-fetch-url", "data-image", "data-background", "hx-get", "hx-post", "hx-put", "hx-delete", "hx-patch", "ng-href", "xlink:href")
#: Patterns of URLs in scripts, in the order in which they are looked for.
SCRIPT_PATTERNS = (
    r"""import\s+(?:[^;]*?\s+from\s+)?["']([^"']+)["']""",
    r"""import\s*\(\s*["']([^"']+)["']\s*\)""",
    r"""require\s*\(\s*["']([^"']+)["']\s*\)""",
    r"""(?i)(?:fetch|axios\.(?:get|post|put|patch|delete)|XMLHttpRequest\.open)\s*\(\s*(?:["'][A-Z]+["']\s*,\s*)?["']([^"']+)["']""",
    r"""(?i)(?:new\s+Worker|navigator\.serviceWorker\.register)\s*\(\s*["']([^"']+)["']""",
    r"""(?i)(?:location(?:\.href)?|window\.location)\s*=\s*["']([^"']+)["']""",
    r"""(?i)(?:router\.push|history\.push|navigate)\s*\(\s*["']([^"']+)["']""",
    r"""(?i)(?:\bpath\b|\bto\b)\s*:\s*["']([^"']+)["']""",
    r"""(?i)["']((?:https?:)?//[^"'\\\s]+|(?:/|\./|\.\./)[^"'\\\s]+)["']""",
)
RAW_TEXT = r"(?is)<!--.*?(?:-->|$)|(<(script|style|textarea|title)\b[^>]*>).*?(?=</\2\b|$)"
START_TAG = r"""<[A-Za-z](?:[^>"']|"[^"]*"|'[^']*')*>"""
ATTRIBUTE = r"""[^\s"'>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
_W = r"[ \t\n\r\x0b\f]"
_QUOTED = r""""((?:\\[\s\S]|[^"\\]|\\\z)*)"?|'((?:\\[\s\S]|[^'\\]|\\\z)*)'?"""
CSS_TOKEN = (
    r"/\*[\s\S]*?(?:\*/|\z)"
    rf"|@import{_W}*(?:url\({_W}*(?:\"([^\"]*)|'([^']*)|([^)]*))[^;]*;?|(?:{_QUOTED})[^;]*;?)"
    rf"|url\({_W}*(?:(?:{_QUOTED})|([^) \t\n\r\x0b\f]*)){_W}*\)?"
)
CSS_COVER = CSS_TOKEN + r"|[^/@u]+|[\s\S]"

LINK = "array<struct<url:string,attribute:string,tag:string,is_stylesheet:boolean,is_script:boolean>>"


def tags(html: Column | str) -> Column:
    """Start tags that have attributes, in order, each a struct of name and attributes (name, value); comments and raw
    text are skipped."""
    found = F.filter(groups(F.regexp_replace(col(html), RAW_TEXT, "$1"), START_TAG, 0), lambda t: F.contains(t, F.lit("=")))

    def attributes(tag: Column) -> Column:
        raw = F.regexp_extract_all(F.regexp_replace(tag, r"^<[^\s>/]+", ""), F.lit(ATTRIBUTE), F.lit(0))
        return F.transform(raw, lambda a: F.struct(ascii_lower(F.regexp_extract(a, r"^([^\s=]+)", 1)).alias("name"), _entities(F.regexp_replace(F.regexp_extract(a, r"(?s)^[^=]+=\s*(.*)$", 1), r"""(?s)^["'](.*)["']$""", "$1")).alias("value")))

    return F.transform(found, lambda t: F.struct(ascii_lower(F.regexp_extract(t, r"^<([^\s>/]+)", 1)).alias("name"), attributes(t).alias("attributes")))


def _entities(text: Column) -> Column:
    for name, sign in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def srcset(value: Column | str) -> Column:
    pieces = F.transform(F.split(col(value), ","), lambda p: F.regexp_extract(trim_space(p), r"^([^\s]+)", 1))
    return F.filter(pieces, lambda p: p != "")


def meta_refresh(content: Column | str) -> Column:
    """URL of a refresh, without quotes, up to a semicolon or space; empty if there is none."""
    return F.regexp_extract(col(content), r"""(?i)url\s*=\s*["']?([^"';\s]*)""", 1)


def html_links(html: Column | str) -> Column:
    """Links in document order with their attribute and tag, by fixed rules, URL attributes of any tag, and handlers."""

    def first(t: Column, name: Column | str) -> Column:
        return F.get(F.filter(t["attributes"], lambda a: a["name"] == name), F.lit(0))["value"]

    def link(url: Column, attribute: Column, t: Column) -> Column:
        sheet = (t["name"] == "link") & F.contains(ascii_lower(F.coalesce(first(t, "rel"), F.lit(""))), F.lit("stylesheet"))
        return F.struct(url.alias("url"), attribute.alias("attribute"), t["name"].alias("tag"), sheet.alias("is_stylesheet"), (t["name"] == "script").alias("is_script"))

    def of_tag(t: Column) -> Column:
        rules = F.array().cast("array<string>")
        for tag, names in TAG_ATTRIBUTES.items():
            rules = F.when(t["name"] == tag, F.array(*map(F.lit, names))).otherwise(rules)
        names = F.filter(rules, lambda n: first(t, n).isNotNull())
        values = lambda n: F.when(n.isin("srcset", "data-srcset"), srcset(first(t, n))).otherwise(F.array(first(t, n)))
        ruled = F.flatten(F.transform(names, lambda n: F.transform(values(n), lambda v: link(v, n, t))))
        refresh = F.when((t["name"] == "meta") & (ascii_lower(F.coalesce(first(t, "http-equiv"), F.lit(""))) == "refresh"), F.array(link(meta_refresh(F.coalesce(first(t, "content"), F.lit(""))), F.lit("content"), t))).otherwise(F.array().cast(LINK))
        anywhere = F.transform(F.filter(t["attributes"], lambda a: a["name"].isin(*ANY_TAG_ATTRIBUTES)), lambda a: link(a["value"], a["name"], t))
        handlers = F.filter(t["attributes"], lambda a: a["name"].isin("onclick", "data-onclick"))
        called = F.flatten(F.transform(handlers, lambda a: F.transform(handler_urls(a["value"]), lambda u: link(u, a["name"], t))))
        return F.concat(refresh, ruled, anywhere, called)

    return F.filter(F.flatten(F.transform(tags(html), of_tag)), lambda x: x["url"] != "")


def handler_urls(code: Column) -> Column:
    """Quoted addresses in the code of an event handler: what the last of the script patterns finds."""
    return groups(code, SCRIPT_PATTERNS[-1])


def base_href(html: Column | str) -> Column:
    """The first base element's href that is not empty; empty if there is none."""
    bases = F.filter(html_attribute(html, "base", "href"), lambda v: v != "")
    return F.coalesce(F.get(bases, F.lit(0)), F.lit(""))


def html_attribute(html: Column | str, tag: str, attribute: str) -> Column:
    own = F.filter(tags(html), lambda t: t["name"] == tag)
    return F.flatten(F.transform(own, lambda t: F.transform(F.filter(t["attributes"], lambda a: a["name"] == attribute), lambda a: a["value"])))


def charset(html: Column | str) -> Column:
    return F.regexp_extract(col(html), r"""(?is)charset[^=]*=\s*["']?([^"'\s;>/]*)""", 1)


def css_refs(css: Column | str) -> Column:
    """Array of (url, is_import) of url() and @import references in order; comments and data: of url() skipped."""
    tokens = groups(col(css), CSS_TOKEN, 0)

    def one(t: Column) -> Column:
        url = F.lit("")
        for n in range(8, 0, -1):
            found = F.regexp_extract(t, CSS_TOKEN, n)
            url = F.when(found != "", found).otherwise(url)
        return F.struct(url.alias("url"), F.startswith(t, F.lit("@import")).alias("is_import"))

    refs = F.transform(F.filter(tokens, lambda t: ~F.startswith(t, F.lit("/*"))), one)
    return F.filter(refs, lambda r: (r["url"] != "") & (r["is_import"] | ~F.startswith(r["url"], F.lit("data:"))))


def css_urls(css: Column | str) -> Column:
    return F.transform(css_refs(css), lambda r: r["url"])


def raw_elements(html: Column | str, tag: str) -> Column:
    """Start tag and text of each raw text element of this name."""
    return F.filter(groups(col(html), RAW_TEXT, 0), lambda m: F.startswith(ascii_lower(F.left(m, F.lit(len(tag) + 1))), F.lit("<" + tag)))


def _inside(element: Column) -> Column:
    return F.regexp_replace(element, r"^<[^>]*>", "")


def inline_css_urls(html: Column | str) -> Column:
    """URLs of style elements, then of style attributes, each once."""
    sheets = F.transform(raw_elements(html, "style"), _inside)
    attributes = F.flatten(F.transform(tags(html), lambda t: F.transform(F.filter(t["attributes"], lambda a: a["name"] == "style"), lambda a: a["value"])))
    return F.array_distinct(F.flatten(F.transform(F.concat(sheets, attributes), lambda c: css_urls(c))))


def js_urls(js: Column | str) -> Column:
    """Likely URLs in a script, pattern by pattern, each once."""
    return F.array_distinct(F.filter(F.concat(*(groups(col(js), p) for p in SCRIPT_PATTERNS)), lambda u: likely_url(u)))


def inline_js_urls(html: Column | str) -> Column:
    """URLs of script elements without a source, each once."""
    own = F.filter(raw_elements(html, "script"), lambda s: ~F.exists(tags(s), lambda t: F.exists(t["attributes"], lambda a: a["name"] == "src")))
    return F.array_distinct(F.flatten(F.transform(own, lambda s: js_urls(_inside(s)))))


#: Attributes that number a page.
PAGING_ATTRIBUTES = ("data-page", "data-page-number", "data-pagenumber")


def page_numbers(html: Column | str, most: int) -> Column:
    """Sorted page numbers 1 to 5000 (and no more than most) of paging attributes; none if there is but one page."""
    numbered = lambda a: a["name"].isin(*PAGING_ATTRIBUTES) & a["value"].rlike("^[0-9]{1,4}$")
    raw = F.flatten(F.transform(tags(html), lambda t: F.transform(F.filter(t["attributes"], numbered), lambda a: a["value"])))
    found = F.sort_array(F.array_distinct(F.filter(F.transform(raw, lambda n: n.cast("int")), lambda n: (n >= 1) & (n <= 5000))))
    top = F.coalesce(F.array_max(found), F.lit(0))
    return F.when(top > 1, F.filter(found, lambda n: n <= most)).otherwise(F.array().cast("array<int>"))


def robots_sitemaps(body: Column | str) -> Column:
    lines = F.transform(F.split(col(body), "\n"), lambda s: F.substring_index(s, "#", 1))
    values = F.transform(F.filter(lines, lambda s: s.rlike(r"(?i)^\s*sitemap:")), lambda s: trim_space(F.regexp_extract(s, r"(?s)^[^:]*:(.*)$", 1)))
    return F.array_distinct(F.filter(values, lambda v: v != ""))


def robots_path(value: Column) -> Column:
    cut = F.replace(F.substring_index(trim_space(value), "*", 1), F.lit("$"), F.lit(""))
    return F.when((cut == "") | cut.rlike("^(https?://|/)"), cut).otherwise(F.concat(F.lit("/"), cut))


def robots_hints(body: Column | str) -> Column:
    """Paths of Allow and Disallow lines, normalized, that name something."""
    lines = F.transform(F.split(col(body), "\n"), lambda s: F.substring_index(s, "#", 1))
    values = F.transform(F.filter(lines, lambda s: s.rlike(r"(?i)^\s*(allow|disallow)\s*:")), lambda s: robots_path(F.regexp_extract(s, r"(?s)^[^:]*:(.*)$", 1)))
    return F.array_distinct(F.filter(values, lambda v: v.rlike("^(https?://|/)") & ~v.isin("", "/", "*")))


def xml_decode(text: Column) -> Column:
    for name, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def sitemap_locs(xml: Column | str) -> Column:
    """Texts of loc elements, decoded and trimmed, each once."""

    def texts(pieces: Column) -> Column:
        starts = lambda p, mark: ascii_lower(F.left(p, F.lit(len(mark)))) == mark
        own = F.filter(pieces, lambda p, i: starts(p, "loc>") & starts(F.get(pieces, i + 1), "/loc>"))
        return F.transform(own, lambda p: xml_decode(trim_space(F.substr(p, F.lit(5)))))

    return F.array_distinct(F.filter(let(F.split(col(xml), "<"), texts), lambda v: v != ""))
