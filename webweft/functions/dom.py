"""HTML as a tree: a tokenizer and tree builder, a Spark stage that turns pages into element rows, and links by rules.

`elements` is one Arrow stage: a page goes in, its elements come out as they end, each with its number in document order
and its parent's; a worker holds a page, its open elements and a bounded number of rows, however many pages there are.
What to make of them is left to Spark: links are the elements' attributes joined with a table of (tag, attribute) rules.

The tokenizer follows HTML: comments, doctypes, raw text, attributes of all quoting forms, the first of repeated
attributes, character references (in attributes a legacy name before a letter, digit or = is text). The tree builder
knows void elements and the ends that start tags and end tags imply; an end tag without its element is ignored. It does
not move misplaced content out of tables or copy unclosed formatting elements: neither changes the order of elements.

Defined cases: a null or empty page has no elements; a page cut off in a tag, comment or quoted value ends before it;
however deep a page is nested, no recursion is used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .extract import ANY_TAG_ATTRIBUTES, TAG_ATTRIBUTES, handler_urls, meta_refresh, srcset
from .text import ascii_lower

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE_RAW = frozenset(("title", "textarea"))
#: Start tags that end an open element, and how far up the tree that reaches.
_BLOCKS = "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    **{t: (frozenset("p"), frozenset("button td th table caption object template html".split())) for t in _BLOCKS},
    "li": (frozenset(("li", "p")), frozenset("ul ol menu dir button td th table object template".split())),
    **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd", "p")), frozenset("dl button td th table object template".split()))),
    **dict.fromkeys(("option", "optgroup"), (frozenset(("option",)), frozenset("select datalist optgroup".split()))),
    **dict.fromkeys(("td", "th"), (frozenset("td th p".split()), frozenset("tr table template".split()))),
    "tr": (frozenset("tr td th p".split()), frozenset("tbody thead tfoot table template".split())),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset("tbody thead tfoot tr td th p caption colgroup".split()), frozenset(("table", "template")))),
}
#: An end tag looks no further up for its element than to these, unless it is one of them.
WALLS = frozenset("table td th caption object template html".split())
_SPACE = " \t\n\f\r"
TAG = re.compile(r"<(/?)([A-Za-z][^\t\n\f\r />]*)")
ATTRIBUTE = re.compile(r"""[\t\n\f\r /]*(?:(>)|(=?[^\t\n\f\r />=]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:"([^"]*)"|'([^']*)'|([^\t\n\f\r >"'][^\t\n\f\r >]*)?))?)""")
REFERENCE = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*)(;?)(?=(.?))", re.S)

#: Rows and bytes of an Arrow batch of pages (a longer page is one by itself), and elements and characters of element rows
#: that a worker holds, at most.
BATCH_ROWS, BATCH_BYTES, HELD, HELD_CHARS = 400, 4_000_000, 10_000, 4_000_000
#: What an attribute of a held row counts beside its characters: a short one takes far more memory than these.
ATTRIBUTE_CHARS = 32
ELEMENT = "node int, parent int, depth int, tag string, names array<string>, values array<string>, text string"


def attribute_value(raw: str) -> str:
    """Character references of an attribute's value decoded."""
    if "&" not in raw:
        return raw

    def one(m: re.Match) -> str:
        name, semicolon, after = m.groups()
        if name[0] == "#":
            return unescape(f"&{name};")
        if semicolon and f"{name};" in html5:
            return html5[f"{name};"]
        # A legacy name needs no semicolon; in an attribute it then stands before no letter, digit or =.
        if not semicolon and name in html5 and after != "=":
            return html5[name]
        return m[0]

    return REFERENCE.sub(one, raw)


def tokens(html: str) -> Iterator[tuple[str, str, list[tuple[str, str]]]]:
    """(kind, name or text, attributes) of start tags, end tags and texts; comments, doctypes and the like are left out."""
    at, size = 0, len(html)
    while at < size:
        tag = html.find("<", at)
        if tag < 0:
            yield "text", unescape(html[at:]), []
            return
        m = TAG.match(html, tag)
        if m is None:
            marked = html.startswith(("<!", "<?", "</"), tag)
            if not marked or tag + 2 >= size and html.startswith("</", tag):
                yield "text", unescape(html[at : tag + 1]), []
                at = tag + 1
                continue
            if tag > at:
                yield "text", unescape(html[at:tag]), []
            if html.startswith("<!--", tag):
                ends = [e for e in (html.find("-->", tag + 4), html.find("--!>", tag + 4)) if e >= 0]
                if html.startswith(("<!-->", "<!--->"), tag):
                    at = html.index(">", tag) + 1
                elif ends:
                    at = html.index(">", min(ends)) + 1
                else:
                    return
            else:
                end = html.find(">", tag)
                if end < 0:
                    return
                at = end + 1
            continue
        if tag > at:
            yield "text", unescape(html[at:tag]), []
        name, found, seen, place = m[2].lower(), [], set(), m.end()
        while (a := ATTRIBUTE.match(html, place)) is not None and a.end() > place and a[1] is None:
            place = a.end()
            if a[2] and a[2].lower() not in seen:
                seen.add(a[2].lower())
                found.append((a[2].lower(), attribute_value(a[3] or a[4] or a[5] or "")))
            if place < size and html[place] in "\"'" and html[place - 1] in "= \t\n\f\r":
                return  # a quoted value without its end
        if a is None or a[1] is None:
            return
        at = a.end()
        yield ("end" if m[1] else "start"), name, found
        if not m[1] and (name in RAW or name in ESCAPABLE_RAW):
            close = re.compile(rf"</{re.escape(name)}(?=[\t\n\f\r />])", re.I).search(html, at)
            inner = html[at : close.start() if close else size]
            if inner:
                yield "text", unescape(inner) if name in ESCAPABLE_RAW else inner, []
            at = close.start() if close else size
        elif not m[1] and name == "plaintext":
            yield "text", html[at:], []
            return


class Element:
    __slots__ = ("node", "parent", "depth", "tag", "attributes", "text")

    def __init__(self, node: int, parent: int, depth: int, tag: str, attributes: list[tuple[str, str]]):
        self.node, self.parent, self.depth, self.tag, self.attributes, self.text = node, parent, depth, tag, attributes, []


def ended(html: str | None) -> Iterator[Element]:
    """The elements of a page, each as soon as it ends. parent: the number of the element around, -1 at the top; text: the
    pieces of text directly in it. Only open elements are held."""
    opened: list[Element] = []
    first: list[str] = []
    node = 0
    for kind, name, attributes in tokens(html or ""):
        if kind == "text":
            if opened:
                opened[-1].text.append(name)
        elif kind == "start":
            if name in ("html", "body", "head") and name in first:
                continue  # repeated ones are no elements
            over, wall = ENDS.get(name, (frozenset(), frozenset()))
            for k in range(len(opened) - 1, -1, -1):
                if opened[k].tag in wall:
                    break
                if opened[k].tag in over:
                    # What stands open inside ends with it; go on, since more than one may end.
                    yield from opened[k:]
                    del opened[k:]
            element = Element(node, opened[-1].node if opened else -1, len(opened), name, attributes)
            node += 1
            if len(first) < 8:
                first.append(name)
            if name in VOID:
                yield element
            else:
                opened.append(element)
        else:
            for k in range(len(opened) - 1, -1, -1):
                if opened[k].tag == name:
                    yield from opened[k:]
                    del opened[k:]
                    break
                if opened[k].tag in WALLS and name not in WALLS:
                    break
    yield from opened


def tree(html: str | None) -> list[Element]:
    """The elements of a page in document order."""
    return sorted(ended(html), key=lambda e: e.node)


def _small_batches(spark: SparkSession) -> None:
    """Lower the session's rows and bytes of an Arrow batch to BATCH_ROWS and BATCH_BYTES if they are more."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        number, unit = re.fullmatch(r"(-?[0-9]+)([kmgtp]?)b?", spark.conf.get(key).strip().lower()).groups()
        now = int(number) * 1024 ** " kmgtp".index(unit or " ")
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def element_batches(batches: Iterator[pa.RecordBatch], html: str, kept: list[str]) -> Iterator[pa.RecordBatch]:
    """Element rows of pages, handed on HELD elements or HELD_CHARS characters at a time, also within a page."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
    names = [*kept, "node", "parent", "depth", "tag", "names", "values", "text"]
    for batch in batches:
        rows: list[tuple] = []
        size = 0

        def done(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
            page, *own = (pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))
            return pa.RecordBatch.from_arrays([*(batch.column(c).take(page) for c in kept), *own], names)

        # Repeated with each element of their page.
        beside = sum(batch.column(c).nbytes for c in kept) // max(batch.num_rows, 1)
        for i, text in enumerate(batch.column(html)):
            for e in ended(text.as_py()):
                own, values = "".join(e.text), [v for _, v in e.attributes]
                rows.append((i, e.node, e.parent, e.depth, e.tag, [n for n, _ in e.attributes], values, own))
                size += beside + len(own) + sum(len(n) + len(v) + ATTRIBUTE_CHARS for n, v in e.attributes)
                if len(rows) >= HELD or size >= HELD_CHARS:
                    yield done(batch, rows)
                    rows, size = [], 0
        if rows:
            yield done(batch, rows)


def elements(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages' other columns and, for each element, node, parent, depth, tag, names and values (of attributes), text.

    Other columns of these names must be put in a struct before. Rows come as elements end; node has their order.
    """
    kept = [f for f in pages.schema.fields if f.name != html]
    if clash := {f.name for f in kept} & {c.split()[0] for c in ELEMENT.split(", ")}:
        raise ValueError(f"columns with names of element columns: {sorted(clash)}")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [ELEMENT])
    names = [f.name for f in kept]
    _small_batches(pages.sparkSession)
    return pages.select(*names, html).mapInArrow(lambda batches: element_batches(batches, html, names), schema)


@udtf(returnType=ELEMENT)
class HtmlElements:
    """SQL: SELECT ... FROM pages, LATERAL html_elements(html)."""

    def eval(self, html: str):
        for e in tree(html):
            yield e.node, e.parent, e.depth, e.tag, [n for n, _ in e.attributes], [v for _, v in e.attributes], "".join(e.text)


#: In the order in which an element's links are listed: refresh, its tag's attributes, attributes of any tag, handlers.
HANDLERS = ("onclick", "data-onclick")


def _rules(spark: SparkSession) -> DataFrame:
    """Some fifty fixed rows: (tag, name, rule), rules numbered in their order; an empty tag is any."""
    rows = [("meta", "content")] + [(tag, name) for tag, names in TAG_ATTRIBUTES.items() for name in names]
    rows += [("", name) for name in (*ANY_TAG_ATTRIBUTES, *HANDLERS)]
    return spark.createDataFrame([(*row, k) for k, row in enumerate(rows)], "rule_tag string, name string, rule int")


def links(found: DataFrame) -> DataFrame:
    """From element rows to one row for each link: node, rule, nth (sort a page's links), tag, attribute, url,
    is_stylesheet, is_script, beside the other columns."""
    others = [c for c in found.columns if c not in ("node", "parent", "depth", "tag", "names", "values", "text")]
    value = lambda name: F.coalesce(F.get("values", F.array_position("names", F.lit(name)).cast("int") - 1), F.lit(""))
    marked = found.select(
        *others, "node", "tag", "names", "values",
        ((F.col("tag") == "link") & F.contains(ascii_lower(value("rel")), F.lit("stylesheet"))).alias("is_stylesheet"),
        (F.col("tag") == "script").alias("is_script"),
        (ascii_lower(value("http-equiv")) == "refresh").alias("_refresh"),
    )
    each = marked.select(*others, "node", "tag", "is_stylesheet", "is_script", "_refresh", F.posexplode(F.arrays_zip("names", "values")).alias("_at", "_a"))
    each = each.withColumns({"name": F.col("_a.names"), "value": F.col("_a.values")})
    met = each.join(F.broadcast(_rules(found.sparkSession)), "name").filter("rule_tag IN ('', tag) AND (name <> 'content' OR _refresh)")
    # Rules of a tag go in their own order, those of any tag in the order in which the attributes stand.
    ordered = met.withColumn("rule", F.when(F.col("rule_tag") != "", F.col("rule")).when(F.col("name").isin(*HANDLERS), 100_000 + F.col("_at")).otherwise(1000 + F.col("_at")))
    urls = (
        F.when(F.col("name").isin("srcset", "data-srcset"), srcset("value"))
        .when(F.col("name").isin(*HANDLERS), handler_urls(F.col("value")))
        .when(F.col("name") == "content", F.array(meta_refresh("value")))
        .otherwise(F.array("value"))
    )
    out = ordered.select(*others, "node", "rule", "tag", F.col("name").alias("attribute"), "is_stylesheet", "is_script", F.posexplode(urls).alias("nth", "url"))
    return out.filter("url <> ''")


def base_href(found: DataFrame, key: str) -> DataFrame:
    """key and base: the first base element's href that is not empty."""
    href = F.get("values", F.array_position("names", F.lit("href")).cast("int") - 1)
    bases = found.filter("tag = 'base'").select(key, "node", href.alias("base")).filter("base <> ''")
    return bases.groupBy(key).agg(F.min_by("base", "node").alias("base"))
