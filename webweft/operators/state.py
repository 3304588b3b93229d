"""Crawl state as tables: frontier, visited, url_map and errors. Every operation is a set-based DataFrame step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scan

FRONTIER = "url string, depth int, status string, added_at long"


def enqueue(frontier: DataFrame, visited: DataFrame, new: DataFrame) -> DataFrame:
    """The frontier with new URLs (url, depth, added_at) that neither table has, at their least depth."""
    first = new.groupBy("url").agg(F.min("depth").alias("depth"), F.min("added_at").alias("added_at"))
    fresh = first.join(frontier.select("url"), "url", "left_anti").join(visited.select("url"), "url", "left_anti")
    return frontier.unionByName(fresh.withColumn("status", F.lit("pending")))


def dequeue(frontier: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(the next n pending rows, the frontier with them in progress), by depth, age and URL."""
    batch = frontier.filter("status = 'pending'").orderBy("depth", "added_at", "url").limit(n)
    taken = batch.select("url", F.lit("in_progress").alias("_status"))
    return batch, _with_status(frontier, taken)


def _with_status(frontier: DataFrame, changes: DataFrame) -> DataFrame:
    return frontier.join(changes, "url", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def mark(frontier: DataFrame, changes: DataFrame) -> DataFrame:
    """Statuses replaced by those of changes (url, status)."""
    return _with_status(frontier, changes.select("url", F.col("status").alias("_status")))


def resume(frontier: DataFrame) -> DataFrame:
    return frontier.withColumn("status", F.when(F.col("status") == "in_progress", "pending").otherwise(F.col("status")))


def upsert(table: DataFrame, rows: DataFrame, key: str, order: Column) -> DataFrame:
    """Last wins: rows of the key with the greatest order replace older ones."""
    columns = table.columns
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.select(*columns).withColumn("_new", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(F.col("_new"), order)).alias("_row")).select(*(F.col("_row")[c].alias(c) for c in columns))


def latest_errors(errors: DataFrame, n: int = 100) -> DataFrame:
    return errors.orderBy(F.desc("at"), F.desc("id")).limit(n)


def circuit_breaker(outcomes: DataFrame, key: str, limit: int = 3) -> DataFrame:
    """For each key whether `limit` timeouts came in a row; successes reset, other failures neither count nor reset.

    outcomes: key, seq, ok, timeout.
    """
    runs = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = outcomes.withColumn("_run", F.sum(F.col("ok").cast("int")).over(runs)).filter("timeout AND NOT ok").groupBy(key, "_run").count()
    tripped = counted.groupBy(key).agg(F.max("count").alias("longest"))
    return outcomes.select(key).distinct().join(tripped, key, "left").select(key, F.coalesce("longest", F.lit(0)).alias("longest"), (F.coalesce("longest", F.lit(0)) >= limit).alias("tripped"))


def add_errors(errors: DataFrame, new: DataFrame) -> DataFrame:
    """Errors with new ones (url, error, at) numbered after the last, in the order of at, url and error."""
    last = errors.agg(F.max("id")).first()[0] or 0
    numbered = scan.numbered(new.select("url", "error", "at"), ["at", "url", "error"], "id").withColumn("id", F.col("id") + last)
    return errors.unionByName(numbered.select(*errors.columns))


def lookup(table: DataFrame, urls: DataFrame) -> DataFrame:
    """The rows of the given URLs, with nulls where the table has none."""
    return urls.select("url").distinct().join(table, "url", "left")


def assign_paths(url_map: DataFrame, wanted: DataFrame) -> DataFrame:
    """The mapping with a pending row for every wanted URL (url, file_path) that it does not have."""
    new = wanted.groupBy("url").agg(F.min("file_path").alias("file_path")).join(url_map.select("url"), "url", "left_anti")
    return url_map.unionByName(new.withColumn("kind", F.lit("pending")).select(*url_map.columns))


def counts(frontier: DataFrame, visited: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: pending, visited, errors."""
    tables = ((frontier.filter("status = 'pending'"), "pending"), (visited, "visited"), (errors, "errors"))
    named = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for t, name in tables]
    every = named[0].unionByName(named[1]).unionByName(named[2])
    return every.agg(*(F.sum(F.when(F.col("table") == name, F.col("n"))).alias(name) for _, name in tables))


def cleared(table: DataFrame) -> DataFrame:
    return table.limit(0)
