"""Static, hybrid or dynamic: a score of a page's HTML by additive rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower, col, contains_any, let

#: Marks of client-side frameworks, and of paging by scripts.
HYDRATION = ("__next_data__", 'id="__next"', "id='__next'", 'id="__nuxt"', "id='__nuxt'", "window.__nuxt__", "data-reactroot", "webpackchunk", "vite/client", "ng-version", "astro-island", "svelte")
INTERACTION = ("data-page", "data-page-number", "data-pagenumber", "load more", "load-more", "infinite-scroll", "infinite scroll", "intersectionobserver", "onscroll", "hx-get", "hx-post", "data-endpoint", "data-url", "data-fetch-url", "onclick")
#: What each rule says, in the order of the rules.
REASONS = (
    "framework hydration markers found",
    "noscript warns about JavaScript dependency",
    "many scripts but very few anchor links",
    "script-heavy page with low link density",
    "low visible text with script-heavy shell",
    "shell-like page with mostly structured/script content",
    "interactive pagination/infinite-scroll markers found",
    "inline JS network calls suggest runtime data loading",
    "JS-first shell with minimal static navigation",
)
NETWORK = ("fetch(", "xmlhttprequest", "axios.")


def anchor_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"(?i)<a\b[^>]*\bhref\s*="))


def script_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"(?i)<script\b"))


def visible_bytes(html: Column) -> Column:
    return F.octet_length(F.replace(F.regexp_replace(html, r"<[^>]*(>|$)", ""), F.lit(">"), F.lit("")))


def site_kind(score: Column) -> Column:
    return F.when(score >= 7, "dynamic").when(score >= 4, "hybrid").otherwise("static")


def detect(html: Column | str) -> Column:
    """Struct of kind, score, reasons (in the order of the rules), static_anchors, scripts, visible_bytes, static_bytes."""
    h = col(html)
    # The page in small letters is made once, each mark looked for once, and what is found used for points and reasons.
    has = lambda low, needle: F.contains(low, F.lit(needle))
    marks = lambda low: F.struct(
        contains_any(low, HYDRATION).alias("hydration"),
        (has(low, "enable javascript") & has(low, "<noscript")).alias("warned"),
        has(low, "application/ld+json").alias("structured"),
        contains_any(low, INTERACTION).alias("interaction"),
        contains_any(low, NETWORK).alias("network"),
    )
    counts = F.struct(let(ascii_lower(h), marks).alias("m"), anchor_count(h).alias("anchors"), script_count(h).alias("scripts"), visible_bytes(h).alias("seen"), F.octet_length(h).alias("size"))

    def judged(c: Column) -> Column:
        m, anchors, scripts, seen = c["m"], c["anchors"], c["scripts"], c["seen"]
        few = (scripts >= 8) & (anchors <= 2)
        rules = (
            (m["hydration"], 5),
            (m["warned"], 2),
            (few, 3),
            ((scripts >= 5) & (anchors <= 4) & ~few, 2),
            ((seen < 250) & (scripts >= 4), 2),
            (m["structured"] & (scripts >= 5) & (seen < 400), 1),
            (m["interaction"], 2),
            (m["network"] & (scripts >= 1), 2),
            ((scripts >= 1) & (anchors <= 1) & (seen < 300), 1),
        )
        points = F.array(*(F.when(rule, n).otherwise(0) for rule, n in rules))

        def told(p: Column) -> Column:
            score = F.aggregate(p, F.lit(0), lambda a, x: a + x)
            reasons = F.array_compact(F.array(*(F.when(F.get(p, F.lit(k)) > 0, F.lit(reason)) for k, reason in enumerate(REASONS))))
            return F.struct(site_kind(score).alias("kind"), score.alias("score"), reasons.alias("reasons"), anchors.alias("static_anchors"), scripts.alias("scripts"), seen.alias("visible_bytes"), c["size"].alias("static_bytes"))

        return let(points, told)

    return let(counts, judged)


def refine(found: Column, rendered: Column) -> Column:
    """The detection again, with the score raised where the rendered page has far more links or bytes."""
    links, size = anchor_count(rendered), F.octet_length(rendered)
    a, b = found["static_anchors"], found["static_bytes"]
    more = F.when((links >= a + 8) & (links >= 2 * a), 4).when(links >= a + 3, 2).otherwise(0)
    larger = F.when((b > 0) & (size > F.floor(b * 3 / 2)), 3).when((b > 0) & (size > F.floor(b * 6 / 5)), 1).otherwise(0)
    score = found["score"] + F.when(rendered.isNull(), 0).otherwise(more + larger)
    return F.struct(site_kind(score).alias("kind"), score.alias("score"), links.alias("rendered_anchors"), size.alias("rendered_bytes"))
