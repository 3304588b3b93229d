"""Analytics of request events: requests in flight, quiet times, the most useful JSON requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scan


def in_flight(events: DataFrame, page: str, change: str, *order: str) -> DataFrame:
    """Adds in_flight: the running sum of +1 (request) and -1 (response or failure) of a page, however many a page has."""
    return scan.running_sums(events, [page], list(order), {"in_flight": change})


#: Addresses, JSON bodies and requests that are kept of a page, tapped bodies in memory.
DISCOVERED_MOST, JSON_MOST, TRACKED_MOST, TAPPED_MOST = 4096, 512, 4096, 200
#: Types of requests that stay open and never count as in flight.
LONG_LIVED = ("websocket", "eventsource")


def changes(events: DataFrame) -> DataFrame:
    """The fold of request events into changes of what is in flight, once for each request and kind of event.

    events: page, ts, seq, request_id, method (requested, finished, failed), type, mime. Long-lived requests are left out.
    """
    streams = events.filter(F.lower("type").isin(*LONG_LIVED) | F.contains(F.lower("mime"), F.lit("event-stream"))).select("page", "request_id").distinct()
    short = events.join(streams, ["page", "request_id"], "left_anti")
    ended = F.when(F.col("method") == "requested", 1).otherwise(-1).alias("change")
    first = short.select("page", "request_id", "ts", "seq", ended).groupBy("page", "request_id", "change").agg(F.min(F.struct("ts", "seq")).alias("at"))
    begun = Window.partitionBy("page", "request_id")
    known = first.withColumn("_begun", F.max("change").over(begun)).filter("_begun = 1")  # an end without a begin changes nothing
    return known.select("page", "request_id", "change", "at.ts", "at.seq")


def network_idle(events: DataFrame, page: str, ts: str, idle_ms: int, loaded: str, patience_ms: int = 1200, *order: str) -> DataFrame:
    """The first time from which nothing is in flight for idle_ms, not before the page is loaded or patience is over.

    events: page, ts (ms), in_flight, loaded (whether the load event has been seen by then).
    """
    own = Window.partitionBy(page)
    following = F.lead(ts).over(own.orderBy(*order))
    rows = events.withColumn("_first", F.min(ts).over(own)).withColumn("_next", following)
    quiet = (F.col("in_flight") <= 0) & (F.col("_next").isNull() | (F.col("_next") - F.col(ts) >= idle_ms))
    ready = F.col(loaded) | (F.col(ts) - F.col("_first") >= patience_ms)
    return rows.filter(quiet & ready).groupBy(page).agg(F.min(ts).alias("idle_from"))


def stops_at(rounds: DataFrame, page: str, growth: str, order: str, least: int = 3, rounds_in_a_row: int = 2) -> DataFrame:
    """The round after which interaction stops: the end of so many rounds in a row that found fewer than `least`."""
    poor = F.coalesce((F.col(growth) < least).cast("int"), F.lit(0))
    marked = rounds.select(page, order, poor.alias("_poor"), (1 - poor).alias("_good"))
    runs = scan.running_sums(marked, [page], [order], {"_run": "_good"})
    counted = scan.running_sums(runs, [page, "_run"], [order], {"_length": "_poor"})
    return counted.filter(F.col("_length") >= rounds_in_a_row).groupBy(page).agg(F.min(order).alias("stops_at"))


def latest(rows: DataFrame, page: str, most: int, *order) -> DataFrame:
    """The last `most` rows of a page, by order: older ones have fallen out."""
    place = F.row_number().over(Window.partitionBy(page).orderBy(*order))
    return rows.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")


def discovered(rows: DataFrame, page: str, url: str, seq: str, most: int = DISCOVERED_MOST) -> DataFrame:
    """page and the sorted addresses found for it: the first `most` different ones."""
    once = rows.groupBy(page, url).agg(F.min(seq).alias("_seq"))
    kept = latest(once, page, most, F.asc("_seq"), F.asc(url))
    return kept.groupBy(page).agg(F.sort_array(F.collect_list(url)).alias("urls"))


def json_requests(ids: DataFrame, urls: DataFrame, pages: DataFrame, most: int) -> DataFrame:
    """Requests for JSON of each page, the most useful first, `most` of a page: page, request_id, url, score, place.

    ids: page, request_id. urls: page, request_id, url; a request without one has its page's. pages: page, page_url.
    """
    named = ids.join(urls, ["page", "request_id"], "left").join(pages, "page").withColumn("url", F.coalesce(F.nullif("url", F.lit("")), "page_url"))
    low = F.lower("url")
    marks = (("/api/", "graphql"), 5), (("page=", "cursor=", "offset=", "/page/"), 4), ((".json", "format=json"), 2)
    score = sum((F.when(low.rlike("|".join(m.replace(".", "[.]") for m in words)), points).otherwise(0) for words, points in marks), F.lit(0))
    place = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("score"), "request_id"))
    return named.withColumn("score", score).withColumn("place", place).filter(F.col("place") <= most).select("page", "request_id", "url", "score", "place")
