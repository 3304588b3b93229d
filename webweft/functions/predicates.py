"""Scope, content kind, link weights and other tests, as boolean or ordinal Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, ascii_lower, contains_any, group, trim_space
from .urls import extension_of, same_origin, should_ignore

#: Extensions of pages and of assets.
HTML_EXTENSIONS = ("html", "htm", "shtml", "xhtml", "php", "phtml", "php3", "php4", "php5", "asp", "aspx", "jsp", "jspx")
ASSET_EXTENSIONS = ("js", "mjs", "cjs", "css", "map", "wasm", "json", "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "bmp", "woff", "woff2", "ttf", "otf", "eot", "mp4", "webm", "mp3", "wav", "pdf")
ASSET_TAGS = ("script", "img", "source", "video", "audio", "object", "embed")
PAGE_TAGS = ("a", "area", "form", "iframe", "frame")
SNIFFED = ("<!doctype html", "<html", "<head", "<body")


def url_allowed(url: Column, include: list[str], exclude: list[str]) -> Column:
    """An include pattern is found (if there are any) and no exclude pattern is; not for an empty URL."""
    found = lambda patterns: any_of([url.rlike("(?i)" + p) for p in patterns if p])
    wanted = found(include) if any(include) else F.lit(True)
    return (url != "") & ~found(exclude) & wanted


def content_type_allowed(content_type: Column, exclude: list[str]) -> Column:
    return (content_type == "") | ~any_of([content_type.rlike("(?i)" + p) for p in exclude if p])


def normalize_alias(text: str) -> str:
    """A host name from a host, host:port or URL that a user gives."""
    host = text.strip().lower()
    host = host.partition("://")[2] if "://" in host else host
    for end in "/?#":
        host = host.partition(end)[0]
    host = host.rpartition("@")[2]
    if host.startswith("["):
        return host.partition("]")[0] + "]" if "]" in host else host
    return host.partition(":")[0]


def in_scope(u: Column, seed: Column, aliases: list[str], same_host: bool, allowed: Column) -> Column:
    """http(s), on the seed's origin (or an alias host) unless any host will do, and allowed by the URL rules."""
    near = same_origin(u, seed) | u["host"].isin(*[normalize_alias(a) for a in aliases]) if aliases else same_origin(u, seed)
    return u.isNotNull() & u["scheme"].isin("http", "https") & (u["host"] != "") & (near if same_host else F.lit(True)) & allowed


def mime_of(header: Column) -> Column:
    return F.rtrim(F.substring_index(header, ";", 1))


def is_html(mime: Column) -> Column:
    return contains_any(ascii_lower(mime), ("text/html", "application/xhtml"))


def is_css(mime: Column) -> Column:
    return contains_any(ascii_lower(mime), ("text/css",))


def is_javascript(mime: Column) -> Column:
    return contains_any(ascii_lower(mime), ("javascript", "ecmascript"))


def is_json(mime: Column) -> Column:
    return contains_any(ascii_lower(mime), ("json",))


def looks_like_html(body: Column) -> Column:
    return contains_any(ascii_lower(F.left(body, F.lit(2048))), SNIFFED)


def content_kind(mime: Column, path: Column, body: Column) -> Column:
    """html, css, js, json or asset: by type, then extension, then the first bytes."""
    ext = extension_of(path)
    html = is_html(mime) | ((mime == "") & ext.isin(*HTML_EXTENSIONS)) | (~is_css(mime) & looks_like_html(body))
    return F.when(html, "html").when(is_css(mime) | (ext == "css"), "css").when(is_javascript(mime) | ext.isin("js", "mjs", "cjs"), "js").when(is_json(mime) | (ext == "json"), "json").otherwise("asset")


def link_weight(tag: Column, is_stylesheet: Column, is_script: Column, path: Column) -> Column:
    """Depth that a link adds: 0 for what a page needs, 1 for another page."""
    ext = extension_of(path)
    return F.when(is_stylesheet | is_script | tag.isin(*ASSET_TAGS), 0).when(tag.isin(*PAGE_TAGS), 1).when((ext == "") | ext.isin(*HTML_EXTENSIONS), 1).otherwise(0)


def script_weight(path: Column) -> Column:
    return F.when(extension_of(path).isin(*ASSET_EXTENSIONS), 0).otherwise(1)


def json_weight(path: Column) -> Column:
    ext = extension_of(path)
    return F.when((ext == "") | ext.isin(*HTML_EXTENSIONS), 1).otherwise(0)


#: Extensions by which a text in a script or a JSON body is taken for a URL.
URL_EXTENSIONS = ("html", "htm", "php", "asp", "aspx", "jsp", "js", "mjs", "cjs", "css", "json", "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "woff", "woff2", "ttf", "otf", "mp4", "webm", "mp3", "wav", "pdf", "xml", "txt")


def likely_url(text: Column, script: bool = True) -> Column:
    """A text of 1 to 2048 bytes that looks like a URL; scripts also build URLs, so theirs must not end in = ? &."""
    size = F.octet_length(text)
    ok = (size >= 1) & (size <= 2048) & ~should_ignore(text)
    if script:
        ok = ok & ~text.rlike("[=?&]$")
    return ok & (F.contains(text, F.lit("/")) | ascii_lower(group(text, r"\.([^.]+)$")).isin(*URL_EXTENSIONS))


def skip_reason(status: Column, scoped: Column, typed: Column, allowed: Column, probing: bool = False) -> Column:
    """failed, skipped or ok: the order of tests on a fetched row."""
    missing = status.isin(404, 410, *((401, 403, 405) if probing else ()))
    good = (status >= 200) & (status < 400)
    return F.when(missing, "skipped:missing").when(~good, "failed").when(~scoped, "skipped:scope").when(~typed, "skipped:type").when(~allowed, "skipped:rule").otherwise("ok")


def retry_after_ms(header: Column) -> Column:
    """Milliseconds of a Retry-After header in seconds, 300 s at most; 0 if it is no number."""
    return F.least(F.coalesce(trim_space(header).try_cast("bigint"), F.lit(0)), F.lit(300)) * 1000


def retry_delay_ms(attempt: Column, url: Column, after_ms: Column, timeout_ms: Column) -> Column:
    """Exponential backoff with a jitter from the URL, never under what the server asks."""
    base = F.least(150 * F.pow(F.lit(2), attempt - 1), F.lit(5000)).cast("bigint")
    jitter = F.pmod(F.crc32(url.cast("binary")) + 97 * attempt, F.lit(125))
    return F.greatest(F.lit(100), F.least(F.greatest(after_ms, base) + jitter, F.greatest(F.lit(1000), F.least(timeout_ms, F.lit(300000)))))
