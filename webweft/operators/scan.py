"""Prefix sums and numbers over ordered rows without a task that sees them all.

Rows are dealt by ranges of (keys, order) and written with their range. Each range sums its own rows; the ranges' totals
of a key, one row a range at most, give what came before; only a key that a range begins in the midst of has something
before, so no more rows than ranges are broadcast. A key that holds all rows is spread over all ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written


def running_sums(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds, for each of sums (new column to summed column), the sum from the key's first row to this one.

    Rows that are equal in keys and order stand in one range and are summed in any order among themselves. Nulls of a
    summed column count as 0.
    """
    if not keys and not order:
        raise ValueError("keys or an order are needed")
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()), "scan")
    own = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumns({f"_own_{n}": F.sum(F.coalesce(F.col(c), F.lit(0))).over(own) for n, c in sums.items()})
    totals = dealt.groupBy("_range", *keys).agg(*(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"_total_{n}") for n, c in sums.items()))
    # A key has one row for each range at most; without keys all ranges are one group of so many rows.
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *keys, *(F.sum(f"_total_{n}").over(before).alias(f"_before_{n}") for n in sums))
    offsets = offsets.filter(F.col(f"_before_{next(iter(sums))}").isNotNull())
    same = F.lit(True)
    for k in ("_range", *keys):
        same = same & summed[k].eqNullSafe(offsets[k])
    met = summed.join(F.broadcast(offsets), same, "left")
    return met.select(*(summed[c] for c in rows.columns), *((F.col(f"_own_{n}") + F.coalesce(F.col(f"_before_{n}"), F.lit(0))).alias(n) for n in sums))


def numbered(rows: DataFrame, order: list[str], name: str, keys: list[str] = ()) -> DataFrame:
    """Adds the rows' numbers from 1 in their order, within each key."""
    return running_sums(rows.withColumn("_one", F.lit(1).cast("long")), list(keys), order, {name: "_one"}).drop("_one")


def retry_order(queue: DataFrame) -> DataFrame:
    """The retry queue in its order: by the time before which a request must not go out, then as it came in.

    queue: url, not_before, seq. Adds place, from 1.
    """
    return numbered(queue, ["not_before", "seq", "url"], "place")
