"""Winnowing, importance resampling and hard negatives against brute force or SQL, and on awkward rows."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from webweft.llm import hard_negatives, importance, queries, winnowing

FOLDER = "/root/testdata/sf0.001"


def plain_rows(df, columns):
    return sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).map(lambda x: int(x) if isinstance(x, float) else x).values.tolist()))


@pytest.mark.parametrize("name", ["op12_resampling", "op13_hard_negatives"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS FROM '{FOLDER}/{file}'")
    got, want = queries.QUERIES[name](spark, FOLDER).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got)
    assert plain_rows(got, columns) == plain_rows(want, columns)


def kept(data: bytes, gram: int = 32, window: int = 64) -> list[tuple[int, int]]:
    """(hash, position) by the definition: every window's least hash, the rightmost of equal ones."""
    if not data:
        return []
    n = max(len(data) - gram + 1, 1)
    hashes = [xxhash.xxh64_intdigest(data[i : i + gram], seed=42) for i in range(n)]
    hashes = [(h if h < 2**63 else h - 2**64) >> 31 for h in hashes]
    out: list[int] = []
    for s in range(max(n - window + 1, 1)):
        at = min(range(s, min(s + window, n)), key=lambda i: (hashes[i], -i))
        if not out or out[-1] != at:
            out.append(at)
    return [(hashes[p] & (2**33 - 1), p) for p in out]


def alike(a, b) -> float:
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_winnowing_against_brute_force(spark):
    """Texts around every bound, without variety, in several scripts and pieces; nulls, ties, repeats and clashing names."""
    rng = random.Random(1)
    texts = ["", "a", None, "x" * 31, "x" * 32, "x" * 94, "x" * 95, "x" * 96, "aé中" * 60, "ab" * 3000, "z" * 9000]
    texts += ["".join(rng.choice("abcdé 中") for _ in range(rng.choice([5, 33, 60, 93, 94, 95, 96, 97, 130, 188, 190, 191, 300, 1000, 9000, 18000]))) for _ in range(40)]
    rng.shuffle(texts)
    rows = [(i * 7 - 100 if i != 5 else None, t, "x") for i, t in enumerate(texts)] + [(3 * 7 - 100, "dup", "x"), (3 * 7 - 100, "dup", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").withColumn("next", F.lit(1))
    got = sorted((tuple(r) for r in winnowing.fingerprints(docs).collect()), key=str)
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or ""))
    shown = lambda f: " ".join(f"{h:x}@{p}" for h, p in f)
    want = []
    for n, (i, x, _) in enumerate(order):
        x, y = x or "", order[(n + 1) % len(order)][1] or ""
        edited = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
        a, b, c = (kept(t.encode()) for t in (x, edited, y))
        want.append((i, len(x), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), alike(a, b), alike(a, c)))
    assert got == sorted(want, key=str)
    assert winnowing.fingerprints(docs.limit(0)).count() == 0
    (one,) = winnowing.fingerprints(docs.filter("text = 'a'")).collect()
    assert one["near_next"] == 1.0 and one["fingerprint"] == one["edited_fingerprint"] == shown(kept(b"a"))


def test_winnowing_guarantee(spark):
    """Two texts that share GUARANTEE bytes in a row share a hash, whatever stands around."""
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choices("abcdefghij", k=n))
    pairs = []
    for i in range(30):
        same = noise(winnowing.GUARANTEE)
        pairs += [(2 * i, noise(rng.randint(0, 300)) + same + noise(50)), (2 * i + 1, noise(rng.randint(0, 300)) + same)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    found = {r["doc_id"]: r["kept"] for r in docs.select("doc_id", F.transform(winnowing.winnow(F.col("text").cast("binary")), winnowing.hash_of).alias("kept")).collect()}
    assert all(set(found[2 * i]) & set(found[2 * i + 1]) for i in range(30))


def test_blocks_rise_with_ids(spark):
    ids = [random.Random(i).choice((i, -i, i * i * i, 2**62 - i, -(2**63) + i, 5)) for i in range(3000)]
    rows = spark.createDataFrame([(i,) for i in ids], "k long")
    found = rows.select("k", winnowing.id_blocks(rows, "k").alias("b")).orderBy("k").collect()
    assert all(a["b"] <= b["b"] for a, b in zip(found, found[1:])) and len({r["b"] for r in found}) > 20


def test_resampling_on_awkward_rows(spark):
    long = " ".join(f"Word{i % 97} é{i}" for i in range(20000))
    texts = [None, "", "...", "One-two\tTHREE é中", "a" * 300 + " b " + "C" * 70, long, long, "one two three"]
    docs = spark.createDataFrame([(None if i == 7 else i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, score int, rank int")
    target = spark.createDataFrame([("one two",), (None,)], "text string")
    counts = {r["bucket"]: r["n"] for r in importance.bucket_counts(docs).collect()}
    want: dict[int, int] = {}
    many = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        many.append(len(runs))
        for r in runs:
            b = zlib.crc32(r.encode()) % importance.BUCKETS
            want[b] = want.get(b, 0) + 1
    assert counts == want
    got = sorted(importance.resample(docs, target, percent=50).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert [r["n_features"] for r in got] == many and [r["weight"] for r in got[:3]] == [0, 0, 0] and got[5]["weight"] == got[6]["weight"]
    assert sorted(r["rank"] for r in got if r["rank"]) == [1] and {r["doc_id"] for r in got if r["rank"]} <= {5, 6}
    assert importance.resample(docs.limit(0), target).count() == 0 and importance.resample(docs, target.limit(0)).count() == 8


def test_ranks_over_ranges(spark):
    """One score for a third of the rows, several ranges: ranks as one sorted list has them."""
    rng = random.Random(6)
    rows = [(i, 7 if i % 3 == 0 else rng.randint(-50, 50), i % 5 > 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, s long, e boolean")
    got = {r["id"]: r["rank"] for r in importance.ranked(df, "s", "id", "e", 25).collect()}
    order = sorted((r for r in rows if r[2]), key=lambda r: (-r[1], r[0]))
    want = {r[0]: n + 1 for n, r in enumerate(order[: len(order) * 25 // 100])}
    assert got == {i: want.get(i) for i, _, _ in rows}


def test_hard_negatives_on_awkward_rows(spark, monkeypatch):
    """Several tiles and chunks, ragged and bad vectors, nulls, ties, repeated rows and clashing names."""
    monkeypatch.setattr(hard_negatives, "ROWS", 40)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=70 if i % 9 else 33)], int(rng.integers(0, 4))) for i in range(300)]
    rows += [(i, rows[i][1], rows[i][2]) for i in range(0, 300, 11)] + [(1000 + i, rows[i][1], rows[i][2]) for i in range(0, 60, 7)]
    rows += [(400, None, 1), (401, [1.0, None], 1), (402, [float("nan")] * 2, 1), (403, [float("inf")], 1), (404, [1.0], None), (None, [1.0], 1), (500, [], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"i": F.lit(1), "x": F.lit("clash"), "rank": F.lit(0)})
    vectors = hard_negatives.quantized(table)
    got = sorted(tuple(r) for r in hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0).collect())
    known = sorted({(r["vec_id"], r["label"], tuple(r["x"])) for r in vectors.collect()})
    assert len(known) == 300 + 9 + 1
    want = []
    for a, label, x in (k for k in known if k[0] % 100 == 0):
        scored = sorted((-sum(p * q for p, q in zip(x, y)), b, other) for b, other, y in known if b != a)
        for s, p, _ in [t for t in scored if t[2] == label][:5]:
            inside = [t for t in scored if t[2] != label and 80 * -s <= 100 * -t[0] <= 100 * -s][:5]
            want += [(a, p, n + 1, b, -s, -t) for n, (t, b, _) in enumerate(inside)]
    assert got == sorted(want) and len(want) > 20
    assert hard_negatives.mine(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(vectors, F.lit(False)).count() == 0
    big = np.array([[2**40, 3]]), np.array([[2**21, 1]])
    assert hard_negatives.product(*big).tolist() == [[2**61 + 3]]


def test_hard_negatives_send_no_block_to_every_task(spark, monkeypatch):
    """Blocks are copied many times, so they meet by key also where Spark takes them for small enough to broadcast."""
    monkeypatch.setattr(hard_negatives, "ROWS", 40)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    vectors = spark.range(300).select(F.col("id").alias("vec_id"), (F.col("id") % 4).cast("int").alias("label"), F.array(*(F.col("id") * 37 % (11 + n) for n in range(70))).alias("x"))
    plans, writer = [], hard_negatives.written
    monkeypatch.setattr(hard_negatives, "written", lambda df, label: plans.append(df) or writer(df, label))
    plans.append(hard_negatives.mine(vectors, F.col("vec_id") % 30 == 0))
    assert plans[-1].count()
    for df in plans:
        df.collect()
        deep = None  # how far in the line of the broadcast stands that the lines below belong to
        for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
            at = re.search(r"[A-Z(=]", line)
            if deep is not None and (at is None or at.start() <= deep):
                deep = None
            assert deep is None or "Generate explode" not in line
            deep = at.start() if deep is None and "BroadcastExchange" in line else deep


def test_hard_negatives_of_vectors_that_share_an_id(spark, monkeypatch):
    """Two vectors of one id and label, of which each is the lesser in one chunk, and numbers of all sizes."""
    monkeypatch.setattr(hard_negatives, "CHUNK", 2)
    for large in (1, 2**12, 2**28):
        rows = [(0, 1, [1, 0, 0, large]), (1, 1, [9, 0, 0, 9]), (2, 2, [1, 0, 0, 8]), (2, 2, [8, 0, 0, 1]), (3, 2, [0, 0, 0, 0])]
        got = hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, label int, x array<long>"), F.col("vec_id") == 0).collect()
        scores = sorted((x[0] + large * x[3] for n, _, x in rows if n == 2), reverse=True)
        positive = 9 + 9 * large
        inside = [s for s in scores if 80 * positive <= 100 * s <= 100 * positive]
        assert [tuple(r) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, n + 1, 2, positive, s) for n, s in enumerate(inside)]
        assert inside or large == 1


def test_html_text_hashes_each_word_once(monkeypatch):
    """Blocks of pages share the hashes of their words, and texts do not depend on which words are known before."""
    from webweft.llm import html_main

    pages = [html_main.unpack(html_main.pack(f"<p>{' '.join(f'w{i * k % 97}' for k in range(60))}</p><p>the same line of ten words stands on every page</p>")) for i in range(40)]
    alone = [t for n in (0, 20) for t in html_main.main_texts(pages[n : n + 20], 40)]
    hashed, real = [], html_main.hashlib.blake2b
    monkeypatch.setattr(html_main.hashlib, "blake2b", lambda w, **how: hashed.append(w) or real(w, **how))
    words = html_main.Words()
    assert [t for n in (0, 20) for t in html_main.main_texts(pages[n : n + 20], 40, None, words)] == alone
    assert len(hashed) == len(set(hashed)) == len({t for p in pages for t in html_main.stream(p)})
    assert words.hashes[words.number["w5"]] == int.from_bytes(real(b"w5", digest_size=8).digest(), "little")
