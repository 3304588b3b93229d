"""Where fetched rows come from: a corpus table joined to the frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webweft.functions.predicates import mime_of
from webweft.functions.text import ascii_lower
from webweft.functions.urls import canonical_key, resolve_key

#: Places where a site tells of its pages.
DISCOVERY_PATHS = ("/robots.txt", "/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap.php")


def responses(batch: DataFrame, corpus: DataFrame) -> DataFrame:
    """The corpus rows (url, html) of a frontier batch (url, depth), joined by identity key."""
    keyed = corpus.withColumn("key", canonical_key("url")).drop("url")
    return batch.withColumn("key", canonical_key("url")).join(keyed, "key", "left").withColumn("found", F.col("html").isNotNull())


def assemble(fetched: DataFrame, max_bytes: int) -> DataFrame:
    """status, content_type and error of fetched rows (status, content_type, body): too large a body is an error."""
    large = F.octet_length("body") > max_bytes
    good = F.col("status").between(200, 399) & ~large
    return fetched.withColumn("content_type", mime_of(F.coalesce("content_type", F.lit("")))).withColumn("error", F.when(large, "Response exceeded max-bytes limit")).withColumn("success", good)


def discovery_seeds(seeds: DataFrame) -> DataFrame:
    """url of each seed's origin with every discovery path. seeds: origin."""
    return seeds.select(F.explode(F.transform(F.array(*map(F.lit, DISCOVERY_PATHS)), lambda p: F.concat(F.col("origin"), p))).alias("url"))


#: Places where sites have their logins, consoles and interfaces; what is tried behind each; other places.
PROBE_BASES = """
/login /signin /sign-in /sign_in /register /signup /sign-up /auth /auth/login /auth/signin /user/login /users/login
/account /account/login /accounts/login /account/signin /my-account /member/login /members/login /client/login
/customer/login /dashboard /panel /control-panel /controlpanel /cpanel /backend /backoffice /console /portal /private
/internal /staff /employee /secure /restricted /intranet /admin /admin/login /admin/signin /admin/panel
/admin/dashboard /admincp /administrator /administrator/login /manager /manage /cms /cms/login /cms/admin /cms-admin
/siteadmin /webadmin /admin-area /control /ops /superadmin /auth/oauth /oauth /oauth/authorize /oauth/login /sso/login
/sso /idp /identity/login /api /api/login /api/auth /api/admin /api/v1 /api/v2 /graphql /graphiql /swagger
/swagger-ui /swagger/index.html /api-docs /openapi /docs/api /prihlaseni /prihlasit /uzivatel/prihlaseni
/administrace /wp-admin /wp-login /wp-login.php /wp-json /xmlrpc.php /phpmyadmin /adminer /adminer.php /umbraco
/typo3 /drupal/user/login /user /users /profile
""".split()
PROBE_SUFFIXES = ("", "/", ".php", ".html", "/index.php", "/index.html")
PROBE_OTHERS = """
/administrator/index.php /admin/index.php /admin/index.html /admin/login.php /admin/login.html /backend/index.php
/backend/login.php /manager/html /cms/admin /cms/login /secure/login /web/admin /admin-ajax.php
/wp-admin/admin-ajax.php /wp-content/uploads/ /uploads/ /media/ /storage/ /vendor/ /.well-known/security.txt
""".split()


def probe_paths(spark) -> DataFrame:
    """position and path of the places to try: every base with every suffix (no second extension), then the others."""
    bases = spark.createDataFrame(list(enumerate(PROBE_BASES)), "i int, base string")
    suffixes = spark.createDataFrame(list(enumerate(PROBE_SUFFIXES)), "j int, suffix string")
    others = spark.createDataFrame([(len(PROBE_BASES), j, p) for j, p in enumerate(PROBE_OTHERS)], "i int, j int, path string")
    # Two fixed lists of some dozen words.
    every = bases.join(F.broadcast(suffixes), ~(F.col("base").rlike("[.](php|html)$") & ~F.col("suffix").isin("", "/")))
    tried = every.select("i", "j", F.concat("base", "suffix").alias("path")).unionByName(others)
    first = tried.groupBy("path").agg(F.min(F.struct("i", "j")).alias("at"))
    return first.select((F.row_number().over(Window.orderBy("at")) - 1).alias("position"), "path")


def extra_seeds(extra: DataFrame, seed: str) -> DataFrame:
    """url of each extra address: absolute ones as they are, others on the seed; canonical, each once. extra: address."""
    return extra.filter("address != ''").select(resolve_key(F.lit(seed), F.col("address")).alias("url")).filter("url != ''").distinct()


def parse_headers(lines: Column) -> Column:
    """Header lines as a map: names in lower case, the last of a name holds; lines without a colon are left out."""
    pairs = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(ascii_lower(F.substring_index(x, ":", 1)).alias("name"), F.regexp_replace(F.substr(x, F.instr(x, ":") + 1), r"^ +|[\r\n]+$", "").alias("value")))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    last = F.aggregate(pairs, empty, lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["name"]), F.map_from_arrays(F.array(p["name"]), F.array(p["value"]))))
    return last


def with_renders(pages: DataFrame, renders: DataFrame) -> DataFrame:
    """pages with the html of their rendering where there is one (url, html, error) that worked."""
    good = renders.filter("error IS NULL AND html != ''").select("url", F.col("html").alias("_rendered"))
    return pages.join(good, "url", "left").withColumn("html", F.coalesce("_rendered", "html")).drop("_rendered")


def files(kept: DataFrame) -> DataFrame:
    """path and content of every document to keep, one row a path: the last written (seq) holds. kept: path, body, seq."""
    return kept.groupBy("path").agg(F.max_by(F.col("body").cast("binary"), "seq").alias("content"))
