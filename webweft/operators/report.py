"""Reports of a crawl: outcome counters, the manifest, signals of a rendered page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webweft.functions.detect import site_kind
from webweft.functions.text import ascii_lower, contains_any

#: What marks an address as an interface, as one of several pages, as a medium.
API_MARKS = ("/api/", "graphql", ".json", "format=json")
PAGE_MARKS = ("page=", "cursor=", "/page/")
MEDIA_MARKS = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".svg")


def runtime_signals(discovered: DataFrame, page: str, url: str) -> DataFrame:
    """Counts of addresses found while a page was rendered: api, paging, media, discovered."""
    low = ascii_lower(url)
    return discovered.groupBy(page).agg(*(F.count_if(contains_any(low, marks)).alias(name) for name, marks in (("api", API_MARKS), ("paging", PAGE_MARKS), ("media", MEDIA_MARKS))), F.count(url).alias("discovered"))


def uplift(anchors: Column) -> Column:
    """What the signals of a page add to its score."""
    found = F.col("discovered")
    rules = ((F.col("api") > 0, 3), (F.col("paging") > 0, 2), ((F.col("media") >= 4) & (found > anchors + 2), 1), ((found >= 8) & (found > anchors + 4), 1))
    return sum((F.when(rule, points).otherwise(0) for rule, points in rules), F.lit(0))


def uplifted_kind(score: Column, anchors: Column) -> Column:
    return site_kind(score + uplift(anchors))


def counters(outcomes: DataFrame) -> DataFrame:
    """outcomes: outcome (page, asset, error, skipped), at (seconds). One row; elapsed is 0 without rows."""
    kinds = [F.count_if(F.col("outcome") == kind).alias(f"{kind}s") for kind in ("page", "asset", "error")]
    return outcomes.agg(*kinds, F.count_if(F.col("outcome") == "skipped").alias("skipped"), F.coalesce(F.max("at") - F.min("at"), F.lit(0)).alias("elapsed")).withColumn("total_files", F.col("pages") + F.col("assets"))


def manifest(outcomes: DataFrame, mappings: DataFrame, config: dict[str, str], shown: int = 100) -> DataFrame:
    """One JSON text: counters, settings, the first mappings (url, path) by URL and how many there are."""
    first = mappings.orderBy("url", "path").limit(shown).agg(F.sort_array(F.collect_list(F.struct("url", "path"))).alias("files"))
    total = mappings.agg(F.count("*").alias("mapped"))
    settings = F.create_map(*(F.lit(x) for pair in config.items() for x in pair)) if config else F.lit(None)
    # Three tables of one row each.
    row = counters(outcomes).join(total, F.lit(True)).join(first, F.lit(True))
    return row.select(F.to_json(F.struct(F.struct("pages", "assets", "errors", "skipped", "elapsed", "total_files").alias("stats"), settings.alias("config"), "files", "mapped")).alias("manifest"))


def error_log(errors: DataFrame, most: int = 1000) -> DataFrame:
    """Lines of the error log, `[at] url: error`, latest first. errors: url, error, at."""
    return errors.orderBy(F.desc("at"), "url").limit(most).select(F.concat(F.lit("["), F.col("at").cast("string"), F.lit("] "), F.coalesce("url", F.lit("")), F.lit(": "), F.coalesce("error", F.lit(""))).alias("line"))
