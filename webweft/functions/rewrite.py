"""Link rewriting for offline reading: attributes and srcset of HTML, url() and @import of CSS."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .extract import CSS_COVER, css_refs, tags
from .text import ascii_lower, col, group, groups, let


def css_rewrite(css: Column | str, mapping: Column) -> Column:
    """Every reference that mapping (url to path) has is written as url("path") or @import "path";."""

    def one(token: Column) -> Column:
        ref = F.get(css_refs(token), F.lit(0))
        path = F.element_at(mapping, ref["url"])
        new = F.when(ref["is_import"], F.concat(F.lit('@import "'), path, F.lit('";'))).otherwise(F.concat(F.lit('url("'), path, F.lit('")')))
        return F.when(token.rlike(r"^(?:@import|url\()") & path.isNotNull(), new).otherwise(token)

    return F.array_join(F.transform(groups(col(css), CSS_COVER, 0), one), "")


def html_rewrite(html: Column | str, pairs: Column) -> Column:
    """Quoted attribute values replaced, longest first. pairs: array of (old, new); later pairs see earlier results."""
    ordered = F.array_sort(F.array_distinct(pairs), lambda a, b: F.when(F.length(a["old"]) != F.length(b["old"]), F.length(b["old"]) - F.length(a["old"])).when(a["old"] < b["old"], -1).when(a["old"] > b["old"], 1).otherwise(0))

    def replace(text: Column, p: Column) -> Column:
        for q in ('"', "'"):
            text = F.replace(text, F.concat(F.lit("=" + q), p["old"], F.lit(q)), F.concat(F.lit("=" + q), p["new"], F.lit(q)))
        return text

    return F.aggregate(ordered, col(html), replace)


def srcset_rewrite(value: Column | str, mapping: Column) -> Column:
    """Each candidate's URL replaced where mapping has it; descriptors kept."""

    def one(piece: Column) -> Column:
        url, rest = F.regexp_extract(piece, r"^\s*(\S+)", 1), F.regexp_extract(piece, r"^\s*\S+\s*(.*?)\s*$", 1)
        new = F.coalesce(F.element_at(mapping, url), url)
        return F.when(rest == "", new).otherwise(F.concat(new, F.lit(" "), rest))

    return F.array_join(F.transform(F.filter(F.split(col(value), ","), lambda p: F.trim(p) != ""), one), ", ")


#: Attributes whose URLs are rewritten; content only of a refresh.
REWRITTEN = ("href", "src", "srcset", "data", "action", "poster", "data-src", "data-srcset", "data-original", "data-lazy-src", "content")
STYLE_ATTRIBUTE = r"""(?i)style\s*=\s*(?:"[^"]*"|'[^']*')"""
STYLE_ELEMENT = r"(?i)<style\b[^>]*>[\s\S]*?</style>"


def mapped(url: Column, mapping: Column) -> Column:
    """The path of a URL with its fragment put back; null where mapping (url without fragment to path) has none."""
    bare = F.substring_index(url, "#", 1)
    return F.concat(F.element_at(mapping, bare), F.substr(url, F.length(bare) + 1))


def refresh_rewrite(content: Column | str, mapping: Column) -> Column:
    """The content of a refresh with its URL, quoted or not, replaced where mapping has it."""

    def one(text: Column) -> Column:
        head = group(text, r"(?i)^([\s\S]*?url=\s*)")
        rest = F.substr(text, F.length(head) + 1)
        quote = group(rest, r"""^(["'])""")
        url = F.when(quote == "", group(rest, r"^([^;\s]*)")).otherwise(group(rest, r"""^["']([^"']*)["']"""))
        new = mapped(url, mapping)
        tail = F.substr(rest, F.length(quote) + F.length(url) + 1)
        return F.when((head != "") & (url != "") & new.isNotNull(), F.concat(head, quote, new, tail)).otherwise(text)

    return let(col(content), one)


def rewrite_pairs(html: Column | str, mapping: Column) -> Column:
    """Array of (old, new) values of the attributes that hold URLs which mapping has."""

    def of_tag(t: Column) -> Column:
        refresh = F.exists(t["attributes"], lambda a: (a["name"] == "http-equiv") & (ascii_lower(a["value"]) == "refresh")) & (t["name"] == "meta")

        def pair(a: Column) -> Column:
            new = (
                F.when(a["name"].isin("srcset", "data-srcset"), srcset_rewrite(a["value"], mapping))
                .when(a["name"] == "content", refresh_rewrite(a["value"], mapping))
                .otherwise(mapped(a["value"], mapping))
            )
            return F.struct(a["value"].alias("old"), new.alias("new"))

        own = F.filter(t["attributes"], lambda a: a["name"].isin(*REWRITTEN) & ((a["name"] != "content") | refresh))
        return F.filter(F.transform(own, pair), lambda p: p["new"].isNotNull() & (p["new"] != p["old"]))

    return F.flatten(F.transform(tags(html), of_tag))


def _spliced(text: Column, pattern: str, one) -> Column:
    """text with every match of a pattern replaced by one(match)."""

    def joined(t: Column) -> Column:
        found = groups(t, pattern, 0)
        gaps = F.split(t, pattern, -1)
        replaced = F.concat(F.transform(found, one), F.array(F.lit("")))
        return F.array_join(F.zip_with(gaps, replaced, lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")

    return let(text, joined)


def inline_css_rewrite(html: Column | str, mapping: Column) -> Column:
    """References in style attributes and style elements replaced; quotes of an attribute are escaped in it."""

    def attribute(token: Column) -> Column:
        value = F.regexp_replace(token, r"(?is)^style\s*=\s*", "")
        quote = F.left(value, F.lit(1))
        css = css_rewrite(F.substr(value, F.lit(2), F.length(value) - 2), mapping)
        safe = F.when(quote == '"', F.replace(css, F.lit('"'), F.lit("&quot;"))).otherwise(F.replace(css, F.lit("'"), F.lit("&#39;")))
        return F.concat(F.lit("style="), quote, safe, quote)

    def element(token: Column) -> Column:
        head = group(token, r"(?is)^(<style\b[^>]*>)")
        css = F.substr(token, F.length(head) + 1, F.length(token) - F.length(head) - 8)
        return F.concat(head, css_rewrite(css, mapping), F.lit("</style>"))

    return _spliced(_spliced(col(html), STYLE_ATTRIBUTE, attribute), STYLE_ELEMENT, element)


def page_rewrite(html: Column | str, mapping: Column) -> Column:
    """A page for reading offline. mapping: URLs as the page writes them, without fragment, to paths."""
    return let(html_rewrite(html, rewrite_pairs(html, mapping)), lambda text: inline_css_rewrite(text, mapping))
