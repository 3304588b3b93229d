"""The frontier's queries where several pages have one address."""

import pytest
from pyspark.sql import functions as F

from webweft.plans import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """150 pages, the last first, five of each address: 0, 30, 60, 90 and 120 are of one."""
    out = str(tmp_path_factory.mktemp("frontier"))
    rows = spark.range(150).repartition(1).sort(F.desc("id"))
    rows.select(F.col("id").alias("page_id"), F.format_string("http://h.x/%d", F.col("id") % 30).alias("url"), F.lit("").alias("html")).write.parquet(f"{out}/pages.parquet")
    return out


def test_enqueue_takes_the_first_page_of_an_address(spark, folder):
    got = sorted((r["added_at"], r["depth"], r["url"], r["status"]) for r in queries.frontier_enqueue(spark, folder).collect())
    # Addresses of pages 0, 3, ... are in the frontier; those of 1, 4, ... were visited; those of 2, 5, ... are new.
    old = [(n, n % 5, f"http://h.x/{n}", "pending") for n in range(0, 30, 3)]
    new = [(n, n % 5 - 1, f"http://h.x/{n}", "pending") for n in range(2, 30, 3)]
    assert got == sorted(old + new)


def test_dequeue_marks_the_same_rows_that_it_takes(spark, folder):
    """All rows are pending and not more than the twenty that are taken: each is marked by its own age."""
    got = {r["url"]: (r["depth"], r["status"], r["added_at"]) for r in queries.frontier_dequeue(spark, folder).collect()}
    ages = [n for n in range(30) if n % 3 != 1]
    assert got == {f"http://h.x/{n}": (n % 5 - (n % 3 == 2), "in_progress" if n % 2 else "done", n) for n in ages}
