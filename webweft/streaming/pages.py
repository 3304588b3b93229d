"""The same extraction over a stream of pages: each canonical URL once within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webweft.functions.extract import html_links
from webweft.functions.urls import canonical_key, resolve_key


def link_stream(pages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """src and dst of every link of new pages. pages: url, html, ts (a stream)."""
    new = pages.withColumn("src", canonical_key("url")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["src"])
    return new.select("src", "ts", F.explode(html_links("html")).alias("link")).select("src", "ts", resolve_key("src", "link.url").alias("dst"))
