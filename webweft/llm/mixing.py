"""Mixing sources to target weights by hierarchical budgeting.

Documents are leaves' rows of a domain-language-source tree. A token budget is split from the root down by the
children's weights; a child that cannot use its share (its supply times max_epochs) leaves the shortage to its
siblings, by their weights, and only what all of them cannot use ever reaches their ancestors: a node's share is
bounded by the supply of its whole subtree before it is split. Each leaf then takes a token prefix of its seeded
epochs: in every epoch the leaf's rows are ordered by a seeded hash of id and text, whole epochs are taken first, then
the prefix that fits the rest.

All of it is DataFrame functions, and texts are never shuffled. One pass over the documents writes `units`: for each
leaf and place in its order the tokens there (some bytes a document). Their sums by 4096 ranges of a leaf's order give
the supplies of the tree, a table of a few rows for each node, which is split one level after the other; and they show
the one range of each leaf that the budget cuts, whose units alone are sorted. So every leaf gets a last place of its
prefix, and a second pass over the documents compares.

Defined cases: null keys of a level are a branch of their own (shown as an empty text); rows without tokens (null or
empty texts) are taken with the prefix that they fall in; rows of one id and one text share a place: the prefix holds
all of them or none; an empty table gives an empty result. The documents' own columns, whatever their names, come out
untouched in the struct `row`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

LEVELS = ("domain", "lang", "source")
BUCKETS = 4096
#: Production weights: by domain and language; what is not named weighs 1. Sources weigh alike.
WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}
#: The share of all tokens that the mix is to have, in thousandths; an epoch more than two is not read.
SHARE, EPOCHS, SEED = 600, 2, "mix-1"


def domain_of(source: Column) -> Column:
    """The domain that a source belongs to, by the number at its end: 0 to 9 web, 10 to 14 books, else code."""
    number = F.coalesce(F.regexp_extract(source, r"(\d+)$", 1).try_cast("int"), F.lit(0))
    return F.when(number < 10, "web").when(number < 15, "books").otherwise("code")


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\r]+")).cast("long")


def _weight(level: str, column: str, weights: dict) -> Column:
    out = F.lit(1)
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(column) == value, w).otherwise(out)
    return out.cast("long")


def _shares(nodes: DataFrame, parents: list[str], level: str, weights: dict, epochs: int) -> DataFrame:
    """Adds budget: what each node may use of its parent's, which stands in `above`. nodes: parents, level, supply, above."""
    nodes = nodes.withColumn("cap", F.col("supply") * epochs).withColumn("w", _weight(level, level, weights))
    family = Window.partitionBy(*(parents or [F.lit(0)]))
    # Water filling: in the order of cap / weight, a prefix of the siblings is filled to its cap.
    siblings = family.orderBy((F.col("cap") / F.col("w")).asc(), F.col(level).asc())
    before = siblings.rowsBetween(Window.unboundedPreceding, -1)
    after = siblings.rowsBetween(0, Window.unboundedFollowing)
    left = F.greatest(F.col("above") - F.coalesce(F.sum("cap").over(before), F.lit(0)), F.lit(0))
    nodes = nodes.withColumn("_left", left).withColumn("_w", F.sum("w").over(after))
    fits = F.col("w") * F.col("_left") >= F.col("cap") * F.col("_w")
    # From the first sibling that is not filled on, what is left is split by weight.
    nodes = nodes.withColumn("_open", F.max(F.when(~fits, F.struct("_w", "_left"))).over(family))
    filled = F.col("_open").isNull() | (F.col("_w") > F.col("_open._w"))
    part = F.floor(F.col("w") * F.col("_open._left") / F.col("_open._w")).cast("long")
    budget = F.when(filled, F.least("cap", "_left")).otherwise(F.least(F.col("cap"), part))
    return nodes.select(*parents, level, "supply", budget.alias("budget"))


def budgets(leaves: DataFrame, total: int, levels: list[str], weights: dict, epochs: int) -> DataFrame:
    """leaves: levels and supply, a written table. Adds the leaf's budget in tokens.

    One row for each node of the tree: every level is summed from the one below it and written once, then split from
    the root down, each level joined to the one above.
    """
    nodes = [leaves.select(*levels, "supply")]
    for depth in range(len(levels) - 1, 0, -1):
        nodes.append(written(nodes[-1].groupBy(*levels[:depth]).agg(F.sum("supply").alias("supply")), "tree"))
    known = None
    for depth, tree in enumerate(reversed(nodes)):
        parents = levels[:depth]
        above = tree.withColumn("above", F.lit(total)) if known is None else tree.join(known.select(*parents, F.col("budget").alias("above")), parents)
        known = _shares(above, parents, levels[depth], weights, epochs)
        if depth < len(levels) - 1:
            known = written(known, "tree")
    return known


#: Leaves up to this number are broadcast; more are joined by their keys.
BROADCAST_LEAVES = 200_000


def mix(documents: DataFrame, tree: dict[str, Column], weights: dict = WEIGHTS, share: int = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The taken rows: `row` (all columns as they came), the levels, n_tokens, and `copies`: in how many epochs each is read.

    documents: has text and doc_id. tree: the levels from the root down and their values, without nulls.
    """
    keys = list(tree)
    seeded = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).cast("binary"))
    levels = [value.alias(level) for level, value in tree.items()]
    rows = documents.select(F.struct(*documents.columns).alias("row"), *levels, tokens_of(F.col("text")).alias("n_tokens"), seeded.alias("place"))
    units = written(rows.groupBy(*keys, "place").agg(F.sum("n_tokens").alias("n_tokens")), "units")
    bucket = F.substring("place", 1, 3)
    sums = written(units.groupBy(*keys, bucket.alias("bucket")).agg(F.sum("n_tokens").alias("n_tokens")), "ranges")
    leaves = written(sums.groupBy(*keys).agg(F.sum("n_tokens").alias("supply")), "leaves")
    supply, many = leaves.agg(F.sum("supply"), F.count("*")).first()
    plan = budgets(leaves, (supply or 0) * share // 1000, keys, weights, epochs)
    whole = F.when(F.col("supply") > 0, F.floor(F.col("budget") / F.col("supply"))).otherwise(0).cast("int")
    plan = written(plan.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("supply")), "plan")
    through = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.join(plan.select(*keys, "rest"), keys).withColumn("end", F.sum("n_tokens").over(through))
    # The first range that does not fit is cut; all before it are inside.
    cut = ends.filter(F.col("end") > F.col("rest")).groupBy(*keys).agg(F.min("bucket").alias("bucket"), F.min(F.col("end") - F.col("n_tokens")).alias("start"), F.min("rest").alias("rest"))
    within = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tried = units.withColumn("bucket", bucket).join(cut, [*keys, "bucket"]).withColumn("end", F.col("start") + F.sum("n_tokens").over(within))
    # Places before the first that does not fit are taken; a leaf without such a place is taken whole.
    stop = tried.filter(F.col("end") > F.col("rest")).groupBy(*keys).agg(F.min("place").alias("stop"))
    decided = written(plan.join(stop, keys, "left").select(*keys, "whole", "stop"), "decided")
    decided = F.broadcast(decided) if many <= BROADCAST_LEAVES else decided
    taken = F.when(F.col("stop").isNull() | (F.col("place") < F.col("stop")), 1).otherwise(0)
    copies = F.least(F.col("whole") + taken, F.lit(epochs)).cast("int")
    return rows.join(decided, keys).select("row", *keys, "n_tokens", copies.alias("copies")).filter("copies > 0")


def tree_of(documents: DataFrame) -> dict[str, Column]:
    """The production tree: domain (by source), lang and source, nulls as empty texts."""
    lang, source = F.coalesce(documents["lang"], F.lit("")), F.coalesce(documents["source"], F.lit(""))
    return {"domain": domain_of(source), "lang": lang, "source": source}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return mix(documents, tree_of(documents)).select("row.doc_id", "domain", "lang", "source", "n_tokens", "copies")


def _weight_sql(level: str) -> str:
    cases = " ".join(f"WHEN {level} = '{v}' THEN {w}" for v, w in WEIGHTS.get(level, {}).items())
    return f"CAST(CASE {cases} ELSE 1 END AS BIGINT)" if cases else "CAST(1 AS BIGINT)"


def _level_sql(depth: int, given: str) -> str:
    """Shares of one level. An independent form: fill rounds of water by a threshold that is tried at each sibling."""
    own, parents = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth]) or "0"
    return f"""
n{depth} AS (SELECT {own}, sum(supply) * {EPOCHS} AS cap, max(budget) AS above, {_weight_sql(LEVELS[depth])} AS w FROM {given} GROUP BY ALL),
f{depth} AS (SELECT *, greatest(above - coalesce(sum(cap) OVER (PARTITION BY {parents} ORDER BY cap::DOUBLE / w, {LEVELS[depth]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS l,
  sum(w) OVER (PARTITION BY {parents} ORDER BY cap::DOUBLE / w, {LEVELS[depth]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s FROM n{depth}),
g{depth} AS (SELECT *, max(CASE WHEN w * l < cap * s THEN s END) OVER (PARTITION BY {parents}) AS os FROM f{depth}),
h{depth} AS (SELECT *, max(CASE WHEN s = os THEN l END) OVER (PARTITION BY {parents}) AS ol FROM g{depth}),
b{depth} AS (SELECT * EXCLUDE (budget, cap, above, w, l, s, os, ol), CAST(CASE WHEN os IS NULL OR s > os THEN least(cap, l) ELSE least(cap, floor(w * ol / os)) END AS BIGINT) AS budget FROM {given} JOIN h{depth} USING ({own}))"""


SQL = f"""
WITH d AS (SELECT doc_id, text, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS n_tokens, md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS o,
    coalesce(try_cast(regexp_extract(coalesce(source, ''), '(\\d+)$', 1) AS INT), 0) AS number FROM documents),
r AS (SELECT *, CASE WHEN number < 10 THEN 'web' WHEN number < 15 THEN 'books' ELSE 'code' END AS domain FROM d),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS supply, floor(sum(sum(n_tokens)) OVER () * {SHARE} / 1000) AS budget FROM r GROUP BY ALL),
{_level_sql(0, "leaf")},{_level_sql(1, "b0")},{_level_sql(2, "b1")},
p AS (SELECT *, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS whole FROM b2),
c AS (SELECT doc_id, domain, lang, source, n_tokens, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY o) AS until FROM r)
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(least(whole + CASE WHEN until <= budget - whole * supply THEN 1 ELSE 0 END, {EPOCHS}) AS INT) AS copies
FROM c JOIN p USING (domain, lang, source) WHERE whole + CASE WHEN until <= budget - whole * supply THEN 1 ELSE 0 END > 0
"""


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents of the mix as they came, once for each epoch that reads them."""
    taken = mix(docs, tree_of(docs)).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("epoch"))
    return taken.select(*(F.col("row")[c].alias(c) for c in docs.columns))
