"""Local file paths of URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, group
from .urls import default_port, extension_of, has_extension

#: Extensions of pages that a server makes.
SERVER_EXTENSIONS = ("php", "phtml", "php3", "php4", "php5", "asp", "aspx", "jsp", "jspx", "cfm", "cgi", "pl")


def query_hash(query: Column) -> Column:
    return F.left(F.md5(query.cast("binary")), F.lit(8))


def site_dir(u: Column) -> Column:
    shown = (u["port"] > 0) & (u["port"] != default_port(u["scheme"]))
    return F.concat(F.lit("site/"), u["host"], F.when(shown, F.concat(F.lit("__p_"), u["port"].cast("string"))).otherwise(""))


def local_path(u: Column) -> Column:
    """site/<host>/...: index pages for folders, .html for server pages, a hash of the query before the extension."""
    path = F.regexp_replace(u["path"], "^/", "")
    named = (
        F.when(path == "", "index.html")
        .when(F.endswith(path, F.lit("/")), F.concat(path, F.lit("index.html")))
        .when(~has_extension(path), F.concat(path, F.lit("/index.html")))
        .when(extension_of(path).isin(*SERVER_EXTENSIONS), F.concat(group(path, r"^(.*)\.[^.]*$"), F.lit(".html")))
        .otherwise(path)
    )
    clean = F.array_join(F.filter(F.split(F.replace(named, F.lit("\\"), F.lit("/")), "/"), lambda s: ~s.isin("", ".", "..")), "/")
    folder, name = group(clean, r"^(.*/)?[^/]*$"), group(clean, r"([^/]*)$")
    mark = F.concat(F.lit("__q_"), query_hash(u["query"]))
    marked = F.when(F.contains(name, F.lit(".")), F.concat(group(name, r"^(.*)\.[^.]*$"), mark, group(name, r"(\.[^.]*)$"))).otherwise(F.concat(name, mark))
    return F.concat(site_dir(u), F.lit("/"), folder, F.when(u["query"] != "", marked).otherwise(name))


def relative_path(source: Column | str, target: Column | str) -> Column:
    """Path of target as seen from the folder of source, with ./ or ../ in front."""
    here, there = F.split(group(col(source), r"^(.*/)?[^/]*$"), "/"), F.split(col(target), "/")
    here = F.slice(here, 1, F.size(here) - 1)
    pairs = F.zip_with(here, F.slice(there, 1, F.size(there) - 1), lambda a, b: a.eqNullSafe(b) & a.isNotNull())
    common = F.coalesce(F.nullif(F.array_position(pairs, F.lit(False)), F.lit(0)) - 1, F.size(pairs)).cast("int")
    up = F.repeat(F.lit("../"), F.size(here) - common)
    rest = F.array_join(F.slice(there, common + 1, F.size(there)), "/")
    return F.concat(F.when(up == "", "./").otherwise(up), rest)
