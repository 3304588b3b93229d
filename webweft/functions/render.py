"""Which pages and responses are worth a browser: hints, decisions and budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .detect import detect
from .text import ascii_lower, contains_any, contains_icase
from .urls import resolve_key, should_ignore

#: Marks of paging and loading by interaction.
HINTS = ("data-page", "data-page-number", "data-pagenumber", "load more", "load-more", "infinite-scroll", "hx-get", "hx-post", "data-endpoint", "data-url", "infinite scroll")
#: Transport errors after which a request is tried again.
RETRYABLE = ("timeout", "connect", "resolve_host", "resolve_proxy", "receive", "send", "empty_reply", "partial_file")


def has_hints(html: Column) -> Column:
    return contains_any(ascii_lower(html), HINTS)


def is_sitemap_path(path: Column) -> Column:
    return contains_icase(path, "sitemap")


def is_sitemap_body(body: Column) -> Column:
    return contains_any(ascii_lower(F.left(body, F.lit(4096))), ("<urlset", "<sitemapindex"))


def is_retryable(error: Column) -> Column:
    return error.isin(*RETRYABLE)


def is_json_response(mime: Column, url: Column, resource: Column) -> Column:
    called = contains_any(ascii_lower(resource), ("xhr", "fetch")) & contains_any(ascii_lower(url), ("/api/", "format=json"))
    return contains_icase(mime, "json") | contains_any(ascii_lower(url), (".json", "/graphql")) | called


def auto_render(html: Column) -> Column:
    """Whether a page by itself asks for a browser."""
    found = detect(html)
    return (found["kind"] == "dynamic") | (found["score"] >= 3)


def should_render(html: Column, depth: Column, mode: str, site_kind: Column, site_score: Column) -> Column:
    """The decision for a page, by the mode of the crawl, what its site is, its depth and its own score."""
    if mode == "static":
        return F.lit(False)
    hints, score = has_hints(html), detect(html)["score"]
    if mode == "dynamic":
        return (depth == 0) | hints
    return (
        F.when(site_kind == "dynamic", (depth == 0) | hints | (score >= 2) | contains_icase(html, "<script"))
        .when(site_kind == "hybrid", hints | (score >= 2))
        .when(site_score >= 3, hints | (score >= 3))
        .otherwise(auto_render(html))
    )


def discovered_url(base: Column, url: Column) -> Column:
    """The canonical text of an address found while a page was rendered; null for what is not followed."""
    usable = ~should_ignore(url) & ~url.rlike("[=?&]$") & (F.octet_length(url) <= 4096)
    return F.when(usable, F.nullif(resolve_key(base, url), F.lit("")))


def interaction_budget(steps: int, signals: bool) -> int:
    """Rounds of interaction with a page: 6 at most, 1 without signals, 2 at least with them."""
    budget = min(max(steps, 0), 6)
    if not signals:
        return min(budget, 1)
    return max(budget, 2) if budget else 0


def json_body_limit(ajax_pages: int, signals: bool, tapped: int) -> int:
    """How many JSON bodies of a page are read."""
    most = min(max(ajax_pages // 2, 16), 96)
    if signals:
        return min(most + 24, 128)
    return min(most, 24) if tapped else most


def site_mode(mode: str, seed: tuple[str, int, list[str]] | None) -> tuple[str, int, list[str]]:
    """Kind, score and reasons of a site. seed: what detection says of its first page; None: it could not be fetched."""
    if mode == "static":
        return "static", 0, ["render mode forced to static"]
    if mode == "dynamic":
        return "dynamic", 999, ["render mode forced to dynamic"]
    return seed if seed is not None else ("static", 0, ["seed fetch failed during auto detection"])
