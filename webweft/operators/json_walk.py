"""Links and paging in JSON bodies: a walk over variants as a recursive query, then windows and joins.

Bodies that are not JSON, and null ones, have no leaves. A leaf in an array has the key of the array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webweft.functions import urls
from webweft.functions.predicates import likely_url
from webweft.functions.text import ascii_lower
from webweft.operators.shared import written

#: Keys of the next page's URL, of the present page and of the last one.
NEXT_KEYS = ("next", "next_page", "nextpage", "next_page_url", "nextpageurl")
CURRENT_KEYS = ("page", "current_page", "currentpage")
TOTAL_KEYS = ("total_pages", "totalpages", "last_page", "lastpage", "pages", "pagecount")


#: Levels that one recursive query walks; what lies deeper is walked by the next.
LEVELS = 80


def leaves(bodies: DataFrame) -> DataFrame:
    """bodies: id, body. Strings and whole numbers with their key: id, place (sorts in the order of the walk), key, kind, text.

    However deep a body is nested, as far as Spark reads it (to 1000 levels; deeper ones are no JSON to it): every LEVELS
    levels what is left is handed to another query. The walk is written, so that ordinary bodies take one.
    """
    spark = bodies.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    walk = f"""
        WITH RECURSIVE w(id, level, place, key, value) MAX RECURSION LEVEL {LEVELS + 2} AS (
          SELECT id, 0, place, key, try_parse_json(body) FROM {{rows}}
          UNION ALL
          SELECT w.id, w.level + 1, concat(w.place, array(e.pos)), coalesce(e.key, w.key), e.value FROM w, LATERAL variant_explode(w.value) AS e WHERE w.level < {LEVELS})
        SELECT id, place, key, schema_of_variant(value) AS kind, CAST(CASE WHEN schema_of_variant(value) IN ('STRING', 'BIGINT') THEN value END AS string) AS text,
          CASE WHEN level = {LEVELS} AND (schema_of_variant(value) LIKE 'ARRAY%' OR schema_of_variant(value) LIKE 'OBJECT%') THEN to_json(value) END AS rest
        FROM w WHERE schema_of_variant(value) IN ('STRING', 'BIGINT') OR level = {LEVELS}"""
    rows = bodies.select("id", F.lit("").alias("key"), F.array().cast("array<int>").alias("place"), "body")
    found = None
    while rows is not None:
        walked = written(spark.sql(walk, rows=rows), "leaves")
        own = walked.filter("kind IN ('STRING', 'BIGINT')").drop("rest")
        found = own if found is None else found.unionByName(own)
        rest = walked.filter("rest IS NOT NULL")
        rows = None if rest.isEmpty() else rest.select("id", "key", "place", F.col("rest").alias("body"))
    return found


def _numbered(found: DataFrame) -> DataFrame:
    """Each URL of a body once, numbered by its first place."""
    once = found.groupBy("id", "url").agg(F.min("place").alias("place"))
    order = Window.partitionBy("id").orderBy("place")
    return once.select("id", (F.row_number().over(order) - 1).alias("position"), "url")


def json_urls(found: DataFrame) -> DataFrame:
    """found: leaves. The texts that look like URLs: id, position, url."""
    return _numbered(found.filter((F.col("kind") == "STRING") & likely_url(F.col("text"), script=False)).withColumnRenamed("text", "url"))


def json_pages(found: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """URLs of other pages: what `next` keys name, then pages 1 to min(total, most) of the source but the present one.

    sources: id, source. The last page number in the order of the walk holds.
    """
    key, number = ascii_lower("key"), F.col("text").cast("int")
    named = found.filter((F.col("kind") == "STRING") & key.isin(*NEXT_KEYS) & likely_url(F.col("text"), script=False)).select("id", F.col("text").alias("url"), "place")
    whole = F.col("kind") == "BIGINT"
    counts = found.filter(whole & key.isin(*CURRENT_KEYS, *TOTAL_KEYS)).groupBy("id").agg(
        F.max_by(number, F.when(key.isin(*CURRENT_KEYS), F.col("place"))).alias("current"),
        F.max_by(number, F.when(key.isin(*TOTAL_KEYS), F.col("place"))).alias("total"),
    )
    paged = counts.filter((F.col("total") > 1) & F.lit(most > 0)).join(sources.select("id", "source"), "id")
    page = paged.select("id", "source", "current", F.explode(F.sequence(F.lit(1), F.least("total", F.lit(max(most, 1))))).alias("n")).filter(F.col("n") != F.coalesce("current", F.lit(1)))
    # Behind all places of the walk, which begin with the number of a member.
    expanded = page.select("id", urls.with_page(urls.url_parse("source"), F.col("n"), urls.JSON_PAGE_KEYS).alias("url"), F.array(F.lit(2**31 - 1), F.col("n")).alias("place"))
    return _numbered(named.unionByName(expanded))
