"""URL algebra as Column expressions: parse, serialize, normalize, resolve, percent codec, query parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower, col, group, let

URL_TYPE = "struct<scheme:string,host:string,port:int,path:string,query:string,fragment:string>"
#: Schemes that are never followed.
IGNORED_SCHEMES = ("mailto", "tel", "javascript", "data", "blob", "about", "file", "ftp", "ws", "wss")
#: Names of page parameters, for HTML links and (wider) for JSON bodies.
PAGE_KEYS = ("page", "p", "paged", "pg")
JSON_PAGE_KEYS = (*PAGE_KEYS, "pagenumber", "page_number")


def url_parse(url: Column | str) -> Column:
    """Struct of scheme, host, port, path, query, fragment; null where the text is no absolute or // URL."""

    def split(u: Column) -> Column:
        k = F.instr(u, "://")
        scheme = F.when(k > 0, ascii_lower(F.substr(u, F.lit(1), k - 1))).when(F.startswith(u, F.lit("//")), F.lit(""))
        return F.struct(scheme.alias("scheme"), F.when(k > 0, F.substr(u, k + 3)).otherwise(F.substr(u, F.lit(3))).alias("rest"))

    def named(a: Column) -> Column:
        authority = F.regexp_replace(group(a.rest, r"^[^/?#]*", 0), r"^[^@]*@", "")
        return let(authority, lambda x: F.struct(a.scheme.alias("scheme"), a.rest.alias("rest"), x.alias("authority"), F.when(F.contains(x, F.lit("[")), group(x, r"^(\[[^\]]*\])")).when(F.contains(x, F.lit(":")), group(x, r"^(.+):[^:]*$")).otherwise(x).alias("host")))

    def fields(b: Column) -> Column:
        x, tail = b.authority, F.substr(b.authority, F.length(b.host) + 1)
        shaped = F.when(F.contains(x, F.lit("[")), x.rlike(r"^\[[^\]]*\](:.*)?$")).when(F.contains(x, F.lit(":")), x.rlike(r"^.+:[^:]+$")).otherwise(x != "")
        number = group(tail, r"^:0*([1-9][0-9]{0,4})$").try_cast("int")
        port = F.when(tail == "", default_port(b.scheme)).when(number <= 65535, number)
        slash, ask, mark = F.instr(b.rest, "/"), F.instr(b.rest, "?"), F.instr(b.rest, "#")
        first = F.least(F.when(ask > 0, ask).otherwise(1 << 30), F.when(mark > 0, mark).otherwise(1 << 30))
        path = F.when(slash == 0, "/").when(slash > first, F.substr(b.rest, slash)).otherwise(group(F.substr(b.rest, slash), r"^[^?#]*", 0))
        query = F.when(ask == 0, "").when((mark > 0) & (mark < ask), F.substr(b.rest, ask + 1)).otherwise(group(F.substr(b.rest, ask + 1), r"^[^#]*", 0))
        fragment = F.when(mark == 0, "").otherwise(F.substr(b.rest, mark + 1))
        out = F.struct(b.scheme.alias("scheme"), ascii_lower(b.host).alias("host"), port.alias("port"), path.alias("path"), query.alias("query"), fragment.alias("fragment"))
        return F.when(b.scheme.isNotNull() & shaped, let(out, lambda o: F.when(o.port.isNotNull(), o)))

    return let(col(url), lambda u: let(split(u), lambda a: let(named(a), fields)))


def default_port(scheme: Column) -> Column:
    return F.when(scheme == "http", 80).when(scheme == "https", 443).otherwise(0)


def _authority(u: Column) -> Column:
    shown = (u["port"] > 0) & (u["port"] != default_port(u["scheme"]))
    return F.concat(u["host"], F.when(shown, F.concat(F.lit(":"), u["port"].cast("string"))).otherwise(""))


def origin(u: Column) -> Column:
    return F.concat(u["scheme"], F.lit("://"), _authority(u))


def to_string(u: Column, fragment: bool = True) -> Column:
    return let(u, lambda v: _text(v, fragment))


def _text(u: Column, fragment: bool) -> Column:
    base = F.concat(F.when(u["scheme"] != "", F.concat(u["scheme"], F.lit("://"))).otherwise("//"), _authority(u), u["path"])
    base = F.concat(base, F.when(u["query"] != "", F.concat(F.lit("?"), u["query"])).otherwise(""))
    return F.concat(base, F.when(u["fragment"] != "", F.concat(F.lit("#"), u["fragment"])).otherwise("")) if fragment else base


def same_origin(a: Column, b: Column) -> Column:
    return (a["scheme"] == b["scheme"]) & (a["host"] == b["host"]) & (a["port"] == b["port"])


def normalize_path(path: Column | str) -> Column:

    def normal(p: Column) -> Column:
        segments = F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))
        stack = F.aggregate(segments, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
        return let(stack, lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when(F.endswith(p, F.lit("/")) & (F.size(k) > 0), "/").otherwise("")))

    return let(col(path), normal)


def canonicalize(u: Column) -> Column:
    """The struct in lower case, with a normalized path and without fragment."""

    def lowered(v: Column) -> Column:
        out = F.struct(ascii_lower(v["scheme"]).alias("scheme"), ascii_lower(v["host"]).alias("host"), v["port"].alias("port"), normalize_path(v["path"]).alias("path"), v["query"].alias("query"), F.lit("").alias("fragment"))
        return F.when(v.isNotNull(), out)

    return let(u, lowered)


def canonical_key(url: Column | str) -> Column:
    """Identity of a URL: its canonical form without fragment, or the text itself if it does not parse."""
    return F.coalesce(to_string(canonicalize(url_parse(url)), fragment=False), col(url))


def resolve(base: Column, reference: Column | str) -> Column:
    """The parsed URL that a reference means on a parsed base; the base where the reference cannot be parsed."""
    return let(F.struct(base.alias("base"), col(reference).alias("reference")), lambda x: let(_target(x.base, x.reference), lambda t: F.when(x.reference == "", x.base).otherwise(F.coalesce(url_parse(t), x.base))))


def _target(base: Column, r: Column) -> Column:
    """The absolute text that a reference means."""
    before = F.substring_index(r, "#", 1)
    fragment = F.when(F.contains(r, F.lit("#")), F.substr(r, F.instr(r, "#") + 1)).otherwise("")
    path = F.substring_index(before, "?", 1)
    query = F.when(F.contains(before, F.lit("?")), F.substr(before, F.instr(before, "?") + 1)).otherwise("")
    query = F.when((path == "") & (query == ""), base["query"]).otherwise(query)
    folder = group(base["path"], r"^(.*/)")
    joined = F.when(path == "", base["path"]).when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(folder, path))
    rebuilt = F.concat(
        origin(base),
        normalize_path(joined),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )
    return F.when(F.contains(r, F.lit("://")), r).when(F.startswith(r, F.lit("//")), F.concat(base["scheme"], F.lit(":"), r)).otherwise(rebuilt)


def resolve_text(base: Column, reference: Column | str) -> Column:
    """Canonical text of a reference on a parsed base; empty if there is no base."""
    return F.coalesce(to_string(canonicalize(resolve(base, reference)), fragment=False), F.lit(""))


def resolve_key(base: Column | str, reference: Column | str) -> Column:
    """Canonical text of a reference on a base's text; empty if the base does not parse."""
    return resolve_text(url_parse(base), reference)


def should_ignore(url: Column | str) -> Column:
    u = col(url)
    return (u == "") | ascii_lower(u).rlike("^(" + "|".join(IGNORED_SCHEMES) + "):")


def percent_decode(text: Column | str) -> Column:
    """%XX to bytes, anything else as it is."""
    pieces = F.regexp_extract_all(col(text), F.lit(r"(?s)%[0-9A-Fa-f]{2}|[^%]+|%"), F.lit(0))
    hexed = F.transform(pieces, lambda p: F.when(p.rlike("^%[0-9A-Fa-f]{2}$"), F.substr(p, F.lit(2))).otherwise(F.hex(p)))
    return F.decode(F.unhex(F.array_join(hexed, "")), "UTF-8")


def percent_encode(text: Column | str) -> Column:
    """All bytes but ASCII letters, digits and -_.~/:@ as %XX."""
    out = F.url_encode(col(text))
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/"), ("%3A", ":"), ("%40", "@")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def extension_of(path: Column | str) -> Column:
    """Lower-case extension of the last segment, without the dot."""
    return ascii_lower(group(col(path), r"[^/]\.([^./]+)$"))


def has_extension(path: Column | str) -> Column:
    return col(path).rlike(r"[^/]\.[^./]+$")


def query_pairs(query: Column) -> Column:
    """Array of (key, value) in order; empty pieces and keys are left out."""
    pairs = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(F.contains(x, F.lit("=")), F.substr(x, F.instr(x, "=") + 1)).otherwise("").alias("value")))
    return F.filter(pairs, lambda p: p["key"] != "")


def _query_text(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.when(p["value"] == "", p["key"]).otherwise(F.concat(p["key"], F.lit("="), p["value"]))), "&")


def page_key(query: Column, keys: tuple[str, ...] = JSON_PAGE_KEYS) -> Column:
    """The first page parameter, as written; `page` if there is none."""
    named = F.filter(query_pairs(query), lambda p: ascii_lower(p["key"]).isin(*keys))
    return F.coalesce(F.get(named, F.lit(0))["key"], F.lit("page"))


def with_page(u: Column, number: Column, keys: tuple[str, ...] = PAGE_KEYS) -> Column:
    """The canonical URL text with its first page parameter set (or `page` added)."""
    pairs = query_pairs(u["query"])
    at = F.array_position(F.transform(pairs, lambda p: ascii_lower(p["key"]).isin(*keys)), F.lit(True))
    value = number.cast("string")
    changed = F.transform(pairs, lambda p, i: F.when(i == at - 1, F.struct(p["key"].alias("key"), value.alias("value"))).otherwise(p))
    added = F.concat(pairs, F.array(F.struct(F.lit("page").alias("key"), value.alias("value"))))
    query = _query_text(F.when(at > 0, changed).otherwise(added))
    return to_string(canonicalize(u.withField("query", query)), fragment=False)
