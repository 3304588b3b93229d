"""The stage that makes element rows holds a bounded number of them."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webweft.functions import dom


def test_rows_are_handed_on_within_a_page_and_between_pages():
    """A page of more elements than a worker may hold, pages of long values, empty ones, and many small ones."""
    wide = "<ul>" + "<li>x<p title=y>" * 12_000 + "</ul><p>end"
    pages = [wide, None, "", "<b>" * 300 + "deep", *(f"<a href='{'v' * 400_000}'>{k}</a><html><body>" for k in range(15)), *["<p>a<td>b</p>c"] * 6000]
    batch = pa.RecordBatch.from_pydict({"html": pages, "id": list(range(len(pages)))})
    out = list(dom.element_batches(iter([batch]), "html", ["id"]))
    assert max(b.num_rows for b in out) <= dom.HELD
    assert max(sum(len(v) for vs in b.column("values").to_pylist() for v in vs) for b in out) <= dom.HELD_CHARS + 400_000
    got = {(r["id"], r["node"]): (r["parent"], r["depth"], r["tag"], r["names"], r["values"], r["text"]) for b in out for r in b.to_pylist()}
    want = {(k, e.node): (e.parent, e.depth, e.tag, [n for n, _ in e.attributes], [v for _, v in e.attributes], "".join(e.text)) for k, p in enumerate(pages) for e in dom.tree(p)}
    assert got == want and len(got) == sum(b.num_rows for b in out)


def test_batches_of_pages_are_small(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        found = dom.elements(spark.createDataFrame([(1, "<p>a<b>c")], "id int, html string"))
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= dom.BATCH_ROWS
        assert sorted((r["node"], r["parent"], r["tag"], r["text"]) for r in found.collect()) == [(0, -1, "p", "a"), (1, 0, "b", "c")]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("limit", ["67108864b", "64m", "1gb"])
def test_batches_of_long_pages_are_small(spark, limit):
    """A site's lists of pages grow with the site: batches of them are bounded by bytes too."""
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]}) for b in batches)
    key, pages = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(0, 100, 1, 1).select("id", F.repeat(F.lit("<br>"), 100_000).alias("html"))
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, limit)
        dom.elements(pages)
        got = [tuple(r) for r in pages.mapInArrow(sizes, "rows long, bytes long").collect()]
    finally:
        spark.conf.set(key, before)
    assert sum(n for n, _ in got) == 100 and max(size for _, size in got) <= dom.BATCH_BYTES + 401_000


def test_smaller_limits_of_the_session_stay(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "100k")
        dom.elements(spark.createDataFrame([(1, "<p>")], "id int, html string"))
        assert spark.conf.get(key) == "100k"
    finally:
        spark.conf.set(key, before)


def test_attributes_without_values_count():
    """What a worker holds is bounded by the attributes, also where none has a value."""
    tag = "<b " + " ".join(f"a{k}" for k in range(1000)) + ">"
    batch = pa.RecordBatch.from_pydict({"html": [(tag + "</b>") * 300], "id": [7]})
    out = list(dom.element_batches(iter([batch]), "html", ["id"]))
    most = max(sum(len(names) for names in b.column("names").to_pylist()) for b in out)
    assert most <= dom.HELD_CHARS // dom.ATTRIBUTE_CHARS + 1000
    assert sum(b.num_rows for b in out) == 300
