"""JSON walks on awkward bodies, settings, the error log."""

import pytest
from pyspark.sql import functions as F

from webweft.operators import json_walk, report
from webweft.plans.config import CrawlConfig


def test_json_awkward(spark):
    nested = '{"a": {"b": [["/x", {"next": "/n?page=2"}], null, 1.5, true, "/x"]}, "Last_Page": 3, "pages": 2}'
    rows = [(1, nested), (2, None), (3, "not json"), (4, '"/top"'), (5, "[]"), (6, '{"next": "word", "pages": 1}')]
    bodies = spark.createDataFrame(rows, "id int, body string").withColumns({"source": F.lit("https://h/l?P=9&q=1"), "place": F.lit(0)})
    found = json_walk.leaves(bodies)
    assert sorted(map(tuple, json_walk.json_urls(found).collect())) == [(1, 0, "/x"), (1, 1, "/n?page=2"), (4, 0, "/top")]
    assert sorted(map(tuple, json_walk.json_pages(found, bodies, 50).collect())) == [(1, 0, "/n?page=2"), (1, 1, "https://h/l?P=2&q=1")]
    assert [tuple(r) for r in json_walk.json_pages(found, bodies, 0).collect()] == [(1, 0, "/n?page=2")]
    assert json_walk.json_urls(json_walk.leaves(bodies.limit(0))).count() == 0


def test_deep_json_beside_good_json(spark):
    """A body of hundreds of levels neither fails the query nor loses leaves; one deeper than the parser reads has none."""
    deep = lambda n: "[" * n + '"/deep.html", {"next": "/n"}' + "]" * n
    bodies = spark.createDataFrame([(1, '{"a": "/x.png", "b": [1, "/y"]}'), (2, deep(110)), (3, deep(320)), (4, deep(3000)), (5, None)], "id int, body string")
    found = sorted((r["id"], r["key"], len(r["place"]), r["text"]) for r in json_walk.leaves(bodies).collect())
    want = [(1, "a", 1, "/x.png"), (1, "b", 2, "/y"), (1, "b", 2, "1")]
    want += [row for i, n in ((2, 110), (3, 320)) for row in ((i, "", n, "/deep.html"), (i, "next", n + 1, "/n"))]
    assert found == sorted(want)
    assert [(r["id"], r["position"], r["url"]) for r in json_walk.json_urls(json_walk.leaves(bodies)).orderBy("id", "position").collect()] == [(1, 0, "/x.png"), (1, 1, "/y"), (2, 0, "/deep.html"), (2, 1, "/n"), (3, 0, "/deep.html"), (3, 1, "/n")]


def test_config():
    made = CrawlConfig.from_profile("deep", url="http://h/", output="o", depth=1)
    assert (made.depth, made.concurrency, made.probing, made.render_mode) == (1, 12, True, "auto")
    assert CrawlConfig.from_profile("dynamic-heavy", url="u", output="o").render_mode == "dynamic"
    assert CrawlConfig(url="u", output="o", render_mode=" Static ").render_mode == "static"
    for wrong in ({"url": " "}, {"concurrency": 0}, {"depth": -1}, {"headers": ("x",)}, {"cookies": ("x",)}, {"render_mode": "other"}):
        with pytest.raises(ValueError):
            CrawlConfig(**({"url": "u", "output": "o"} | wrong))
    with pytest.raises(ValueError):
        CrawlConfig.from_profile("quick", url="u", output="o")


def test_reports(spark):
    errors = spark.createDataFrame([("b", "e1", 5), ("a", "e2", 5), ("c", None, 9)], "url string, error string, at long")
    assert [r["line"] for r in report.error_log(errors, 2).collect()] == ["[9] c: ", "[5] a: e2"]
    none = spark.createDataFrame([], "outcome string, at long")
    text = report.manifest(none, spark.createDataFrame([], "url string, path string"), {}).first()["manifest"]
    assert '"total_files":0' in text and '"mapped":0' in text
