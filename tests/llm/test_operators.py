"""Each operator against a brute-force form, a library or held-out labels, and on awkward rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webweft.llm import decontamination, html_main, langid, media, mixing, near_dup, quality, token_counts, token_files, toxicity
from webweft.llm.common import table

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 977} und {i}" for i in range(30000))
    rows = [(1, None, None, None, None), (2, "", "en", "src1", 0), (3, "one two", "en", "src1", 7), (3, "one two", "en", "src1", 7), (4, "one two", None, "src1", 7), (None, "A b  c\n\nd é 中 <|endoftext|> <s>", "fr", None, 1), (5, long, "de", "src2", 1), (6, long, "de", "src2", 1), (7, " \t\n ", "es", "src3", 3), (8, "12345 --- !!!", "es", "src3", 3)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit(1), "node": F.lit("x"), "copies": F.lit(2), "range": F.lit(0), "_i": F.lit(0)})


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"] or "") for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()]


def remainder(i, k):
    return zlib.crc32(str(i).encode()) % k


def test_quality_held_out(spark, odd):
    got = {r["doc_id"]: r for r in quality.op1_quality(spark, FOLDER).collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, FOLDER, "labels").collect()}
    assert len(got) == 1000 and all(r["held_out"] == (remainder(i, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    held = [got[i]["predicted"] == y for i, y in labels.items() if got[i]["held_out"]]
    assert np.mean(held) > 0.95
    model = quality.fit([("a good text", 1), ("bad bad bad %%%", 0)] * 5)
    assert quality.score(odd, model).count() == 10
    assert quality.score(odd.limit(0), model).count() == 0
    assert quality.fit([]).scores(pa.array(["x", ""])).tolist() == [0.5, 0.5]


def test_toxicity_held_out(spark, odd):
    got = {r["doc_id"]: r for r in toxicity.op2_toxicity(spark, FOLDER).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, FOLDER, "labels").collect()}
    held = [(got[i]["predicted"], y) for i, y in labels.items() if got[i]["held_out"]]
    assert all(r["held_out"] == (remainder(i, 3) == 1) for i, r in got.items())
    assert np.mean([p == y for p, y in held]) > 0.9
    assert np.mean([p for p, y in held if y]) > 0.6 and np.mean([y for p, y in held if p]) > 0.8  # recall, precision
    repeated = [r["score"] for r in toxicity.score(odd, toxicity.fit([("a bad word", 1), ("a good word", 0)] * 8, rounds=1, steps=3)).filter("doc_id = 3").collect()]
    assert len(repeated) == 2 and len(set(repeated)) == 1
    assert toxicity.ToxicityModel(constant=1.0).scores(pa.array(["a"])).tolist() == [1.0]
    model = toxicity.fit([("you are a total idiot", 1), ("what a fine day it is", 0)] * 8, rounds=1, steps=3)
    assert toxicity.score(odd, model).count() == 10 and toxicity.score(odd.limit(0), model).count() == 0


def test_windows_cover_everything():
    from webweft.llm.textvec import Words

    words = Words(pa.array(["", " ".join(f"w{i}" for i in range(100)), "a"], pa.large_string()))
    at, owner = toxicity.windows(words)
    assert collections.Counter(owner.tolist()) == {0: 1, 1: 10, 2: 1}
    assert set(at[owner == 1].ravel().tolist()) - {-1} == set(range(100))


def test_gradient_of_the_network():
    rng = np.random.default_rng(0)
    model = toxicity.fit([("you are a total idiot", 1), ("what a fine day it is", 0)] * 8, rounds=1, steps=2)
    x = rng.standard_normal((6, model.p["in"].shape[1])).astype(np.float32)
    x[-1] = 0
    idx, y = rng.integers(0, 6, (3, 32)), np.array([1.0, 0.0, 1.0])
    loss = lambda: float(np.mean(np.logaddexp(0, (z := model.forward(x, idx).astype(float))) - y * z))
    grads, _ = toxicity._backward(model, x, idx, y)
    for name in ("rec", "in", "attend", "out"):
        flat, g = model.p[name].reshape(-1), grads[name].reshape(-1)
        for k in rng.integers(0, len(flat), 4):
            keep = flat[k]
            flat[k] = keep + 1e-2
            up = loss()
            flat[k] = keep - 1e-2
            down = loss()
            flat[k] = keep
            assert abs((up - down) / 2e-2 - g[k]) < 2e-3 + 0.05 * abs(g[k])


def test_html_text(spark):
    page = lambda n, extra="": f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=x>Home page of us</a></nav><div>Read our terms of use today</div><article><header><h1>Title {n}</h1></header><p>Body&nbsp;{n} &amp; more<br>line<p>Next <b>bo</b>ld</p><div class='comments'>I like it</div></article>{extra}<script>x</script><footer>f</footer></body></html>"
    plain = lambda n: f"<body><p>Subscribe to our weekly letter now</p><p>Unique text number {n} stands here {n * 7}</p></body>"
    rows = [(1, "http://a.x/1", page(1)), (2, "http://a.x/2", page(2, "<p>Only on this page of all</p>")), (3, "http://b.x/1", plain(1)), (4, "http://b.x/2", plain(2)), (5, None, None), (6, "", ""), (7, "http://c.x/", "<article>cut &am"), (7, "http://c.x/", "<article>cut <b"), (8, "http://d.x", "<article>a<!-- x")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = [(r["page_id"], r["text"]) for r in html_main.extract(docs).collect()]
    assert sorted(got) == [(1, "Title 1 Body 1 & more line Next bold"), (2, "Title 2 Body 2 & more line Next bold Only on this page of all"), (3, "Unique text number 1 stands here 7"), (4, "Unique text number 2 stands here 14"), (5, ""), (6, ""), (7, "cut"), (7, "cut &am"), (8, "a")]


def test_html_runs_repeated_across_blocks(spark, monkeypatch):
    """Boilerplate on few pages of a large host goes, and neither block size nor partitions change a result."""
    notice = "Our office is closed on every public holiday"
    rows = [(i, f"http://big.x/{i}", f"<p>{' '.join(f'u{i}w{k}' for k in range(9))}</p>" + (f"<p>{notice} only{i}</p>" if i % 150 == 0 else "")) for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = [(i, " ".join(f"u{i}w{k}" for k in range(9)) + (f" only{i}" if i % 150 == 0 else "")) for i in range(600)]
    for size, partitions in ((256, "4"), (5, "3"), (10000, "1")):
        monkeypatch.setattr(html_main, "PAGES", size)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = [(r["page_id"], r["text"]) for r in html_main.extract(pages).collect()]
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert sorted(got) == want


def test_html_boilerplate_inside_articles(spark, monkeypatch):
    """What stands on many pages of a host goes from articles too, by the suffix array alone; copies of articles stay."""
    notice = "Sign up for our weekly letter with all of the news"
    body = lambda i: " ".join(f"u{i}w{k}" for k in range(20))
    rows = [(i, f"http://n.x/{i}", f"<article><p>{body(i)}</p><p>{notice}</p><p>end {i}</p></article>") for i in range(6)]
    rows += [(10 + i, f"http://c.x/{i}", f"<article><p>{body(100)}</p></article>") for i in range(5)]
    rows += [(20 + i, f"http://p.x/{i}", f"<p>{body(100)}</p>") for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = [(i, f"{body(i)} end {i}") for i in range(6)] + [(i, body(100)) for i in (10, 11, 12, 13, 14, 20, 21)]
    for size, partitions in ((256, "4"), (1, "1"), (2, "211")):
        monkeypatch.setattr(html_main, "PAGES", size)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = [(r["page_id"], r["text"]) for r in html_main.extract(pages).collect()]
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert sorted(got) == want
    packed = [html_main.unpack(html_main.pack(h)) for _, _, h in rows[:6]]
    monkeypatch.setattr(html_main, "parts", lambda tokens, page, run=8: (np.zeros(0, int), np.zeros(0, int)))
    assert html_main.main_texts(packed, 6) == [f"{body(i)} {notice} end {i}" for i in range(6)]


def test_html_of_ordinary_pages():
    """Class names count whole, never on the elements around everything; unclosed elements end where HTML ends them."""
    text = lambda h: html_main.main_texts([html_main.unpack(html_main.pack(h))], 1)[0]
    assert text('<body class="page has-sidebar"><article><p>Real text</article>') == "Real text"
    assert text('<html class="no-search"><main><p>Real text</main>') == "Real text"
    assert text('<article><div class="search-results-page"><p>body</div></article>') == "body"
    assert text('<div><p class="share">x<p>Next real paragraph</div>') == "Next real paragraph"
    assert text("<ul><li class=ad>x<li>kept</ul><table><tr><td class=widget>y<td>cell</table>") == "kept cell"
    assert text('<div class="cookie-notice">a</div><div class="site-nav">b</div><div id=related-posts>c</div>d') == "d"
    assert text('<article><p>One</p><p title="5" tall">Two</p><p title="a>b">Three</p></article>') == "One Two Three"
    assert text('<article>a <span class="ad">buy <span>now</span></span>b <a class="nav-link" href=x>home</a><i class="comment">c</i></article>') == "a b c"
    assert text('<article><span class="promo">never closed<p>next</p><p hidden>x</p><p style="color:red; display: none">y</p><p title="hidden">z</p></article>') == "next z"
    long = " ".join(f"w{i}" for i in range(60000))
    assert text(f"<article>{long}</article>") == long


def test_html_keeps_chance_repeats_in_articles(spark):
    """A line on a third of a host's pages stays, and a heading stays however often it stands there; empty tables are no case."""
    line, head = "the same line of eight or more plain words", "one heading that all of the pages of this host have"
    body = lambda i: " ".join(f"u{i}w{k}" for k in range(20))
    rows = [(i, f"http://n.x/{i}", f"<article><h1>{head}</h1><p>{body(i)}</p>" + (f"<p>{line}</p>" if i % 3 == 0 else "") + "</article>") for i in range(15)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"], r["text"]) for r in html_main.extract(pages).collect())
    assert got == [(i, f"{head} {body(i)}" + (f" {line}" if i % 3 == 0 else "")) for i in range(15)]
    assert html_main.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.1"])
def test_html_against_brute_force(spark, folder):
    """The query's texts: each page's article, by another reading of the same html."""
    import html as html_lib
    import re

    rows = {r["page_id"]: r for r in table(spark, folder, "pages").collect()}
    got = html_main.op3_html_text(spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        article = re.search(r"<article>(.*?)(?:</article>|$)", rows[r["page_id"]]["html"] or "", re.S)
        inner = re.sub(r"</?(?:b|a|i|em|strong|span)\b[^>]*>", "", article[1] if article else "")
        want = " ".join(html_lib.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert (r["url"], r["text"], r["n_chars"]) == (rows[r["page_id"]]["url"], want, len(want))


def test_repeated_runs_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        pages = [[rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(4)]
        tokens, page = np.array([t for p in pages for t in p], int), np.array([i for i, p in enumerate(pages) for _ in p], int)
        suffix_array, group = html_main.parts(tokens, page, 4)
        many = html_main.pages_of(suffix_array, group, page)
        for least in (2, 3):
            want = []
            for p in pages:
                hit = [False] * len(p)
                for a in range(len(p) - 3):
                    if sum(any(p[a : a + 4] == q[b : b + 4] for b in range(len(q) - 3)) for q in pages) >= least:
                        hit[a : a + 4] = [True] * 4
                want += hit
            assert html_main.covered(suffix_array[(many >= least)[group]], len(tokens), 4).tolist() == want


def test_token_counts(spark, odd, texts):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r for r in token_counts.op4_token_counts(spark, FOLDER).collect()}
    for i, t in texts:
        assert (got[i]["n_tokens"], got[i]["n_bytes"]) == (len(library.encode(t)), len(t.encode())) and got[i]["over_limit"] == (got[i]["n_tokens"] > 4096)
    again = sorted((r["text"] or "") for r in odd.collect())
    assert sorted(r["n_tokens"] for r in token_counts.count_tokens(odd, path).collect()) == sorted(len(library.encode(t)) for t in again)
    assert token_counts.count_tokens(odd.limit(0), path).count() == 0


def test_media(spark, odd, texts):
    got = {r["doc_id"]: r for r in media.op5_media(spark, FOLDER).collect()}
    assert len(got) == 1000
    for i, t in texts:
        data = t.encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = media.encode_png(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest()) and media.decode_png(stored) == (192, payload)
    parts = media.parse('<p>One<figure><img data-digest="ab" alt="x"><figcaption>A &amp; B</figcaption></figure>Two<img src="media:cd">')
    assert [(p["position"], p["kind"], p["text"], p["digest"], p["caption"]) for p in parts] == [(0, "text", "One", None, None), (1, "media", None, "ab", "A & B"), (2, "text", "Two", None, None), (3, "media", None, "cd", None)]
    pages = spark.createDataFrame([(1, '<img data-digest="a"><img data-digest="zz">'), (2, None)], "k long, html string")
    found = media.resolve(media.sequences(pages, "k", "html"), spark.createDataFrame([("a", 9)], "digest string, size int")).collect()
    for i, t in texts:  # the texts around each figure, in order
        lines = [" ".join(line.split()) for line in t.split("\n")]
        assert got[i]["texts_sha256"] == hashlib.sha256("\n".join(x for x in lines if x).encode()).hexdigest() and got[i]["position"] == sum(map(bool, lines))
    assert sorted((r["k"], r["position"], r["digest"], r["size"]) for r in found) == [(1, 0, "a", 9), (1, 1, "zz", None)]


def test_mixing(spark, odd):
    rows = [(i, "w " * 10, lang, source, 0) for i, (lang, source) in enumerate([("en", "src1")] * 50 + [("de", "src2")] * 2 + [("en", "src12")] * 40 + [("en", "src19")] * 8)]
    got = mixed(spark.createDataFrame(rows, SCHEMA), epochs=1).groupBy("domain", "lang").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).collect()
    share = {(r["domain"], r["lang"]): r["n"] for r in got}
    # 600 tokens: web 5, books 3, code 2 of ten; code has only 80, its shortage goes to web and books.
    assert share == {("web", "en"): 300, ("web", "de"): 20, ("books", "en"): 190, ("code", "en"): 80}
    out = mixed(odd, share=1000).select("row.*").collect()
    assert 0 < len(out) <= 10 and all((r["copies"], r["node"]) == (2, "x") for r in out)
    assert mixed(odd.limit(0)).count() == 0
    # Columns of the caller with the operator's own names come out of the stage as they went in.
    clash = odd.withColumns({c: F.lit("mine") for c in ("domain", "n_tokens", "copies", "budget", "place", "row", "bucket", "epoch", "stop")})
    out = mixing.mix_stage(spark, clash, FOLDER)
    assert out.schema.names == clash.schema.names
    assert {tuple(r[c] for c in ("domain", "n_tokens", "copies", "budget", "place", "row", "epoch")) for r in out.collect()} == {("mine",) * 7}
    assert mixing.mix_stage(spark, odd.limit(0), FOLDER).count() == 0
    # Repeated rows, and rows without an id, stand in the order together; the prefix holds all of a place or none.
    same = spark.createDataFrame([(None, "a b", "en", "src1", 0)] * 30 + [(i, "a b", "en", "src1", 0) for i in range(30)], SCHEMA)
    got = mixed(same, share=500, epochs=1)
    kept = [r["row"]["doc_id"] for r in got.collect()]
    assert kept.count(None) in (0, 30) and 0 <= 30 - len(kept) < 30


def mixed(documents, **settings):
    return mixing.mix(documents, mixing.tree_of(documents), **settings)


def test_mixing_stage_meets_the_weights(spark):
    """Tokens that leave the stage: a leaf that is read in two epochs counts twice."""
    rows = [(i, "w " * 10, "en", source, i) for i, source in enumerate(["src1"] * 82 + ["src12"] * 10 + ["src19"] * 8)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix_stage(spark, docs, FOLDER)
    assert out.schema.names == docs.schema.names
    # 600 tokens: web 5, books 3, code 2 of ten; books has 100 and code 80.
    assert {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(mixing.tokens_of(F.col("text"))).alias("n")).collect()} == {"src1": 300, "src12": 180, "src19": 120}
    docs = table(spark, FOLDER, "documents").withColumn("source", F.concat(F.lit("src"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 20)).withColumn("lang", F.lit("en")).filter(F.length("text") < 3000)
    totals = [d.select("text", mixing.tree_of(d)["domain"].alias("domain")).groupBy("domain").agg(F.sum(mixing.tokens_of(F.col("text"))).alias("n")).collect() for d in (docs, mixing.mix_stage(spark, docs, FOLDER))]
    before, after = ({r["domain"]: r["n"] for r in t} for t in totals)
    for domain, w in mixing.WEIGHTS["domain"].items():
        assert after[domain] / sum(before.values()) == pytest.approx(0.6 * w / 10, rel=0.08)


def shingles(text):
    w = text.lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates_against_brute_force(spark, odd, texts):
    sets = {i: shingles(t) for i, t in texts}
    where = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    links, root = collections.Counter(), {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, s in sets.items():
        for j in {j for g in s for j in where[g] if j < i}:
            if len(s & sets[j]) / len(s | sets[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = near_dup.op7_near_dup(spark, FOLDER).collect()
    assert len(got) == len(sets) and all((r["class_id"], r["n_links"]) == (find(r["doc_id"]), links[r["doc_id"]]) for r in got)
    small = {r["doc_id"]: r["class_id"] for r in near_dup.join(odd).collect()}
    assert small[3] == small[4] == 3 and small[5] == small[6] == 5 and small[2] == small[1] == small[7] == 1 and small[8] == 8
    assert near_dup.join(odd.limit(0)).count() == 0
    kept = near_dup.keep_one(spark, odd, FOLDER)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 5, 8]


def test_near_duplicates_of_one_large_group(spark):
    """More nodes than a block, each similar to many others: links counted across blocks."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(900):
        words = list(base)
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    sets = [shingles(t) for _, t in rows]
    got = {r["doc_id"]: r for r in near_dup.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in (0, 450, 899):
        assert got[i]["n_links"] == sum(len(sets[i] & s) / len(sets[i] | s) >= 0.8 for j, s in enumerate(sets) if j != i)
    assert {r["class_id"] for r in got.values()} == {0}


def test_matched_prefixes_are_shortened_until_the_recall():
    """Nearly equal texts need no short prefixes; texts at the threshold do."""
    stop = lambda found, recall=0.9999: near_dup.stop_depth(found, 0.8, recall)
    assert stop([]) == stop([(8, 0.99, 1000)]) == 8
    assert stop([(8, 0.9, 990), (7, 0.82, 10)]) == 7 and stop([(8, 0.9, 990), (7, 0.82, 10)], 0.98) == 8
    assert stop([(8, 0.8, 900), (6, 0.8, 90), (5, 0.8, 10)]) == 5


def test_trie_is_read_alike_in_any_batches():
    """Leaders and depths against prefixes compared one by one, whatever the size of the batches."""
    rng = random.Random(9)
    rows = sorted((rng.randrange(2), int.from_bytes(bytes(rng.choice((0, 0, 0, 255)) for _ in range(8)), "big") - (1 << 63), i) for i in range(300))
    want, leaders = set(), {}
    for tree, path, node in rows:
        key = path + (1 << 63)
        for depth in range(near_dup.DEPTH, near_dup.SHALLOWEST - 1, -1):
            leader = leaders.setdefault((tree, depth, key >> 8 * (8 - depth)), node)
            if leader != node and not any(w[:2] == (node, leader) for w in want):
                want.add((node, leader, depth))
    for size in (1, 7, 300):
        parts = [rows[i : i + size] for i in range(0, 300, size)]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in p], pa.int64()) for k in range(3)], ["tree", "path", "node"]) for p in parts]
        got = [tuple(r.values()) for b in near_dup.read_trie(iter(batches)) for r in b.to_pylist()]
        assert {(n, m): max(d for a, b, d in got if (a, b) == (n, m)) for n, m, _ in got} == {(n, m): d for n, m, d in want}


def test_near_duplicates_by_text_not_by_id(spark):
    """Repeated and missing ids keep the links of their own texts."""
    text = lambda k, extra="": " ".join(f"{k}{i}" for i in range(400)) + extra
    rows = [(1, text("t")), (1, text("u")), (2, text("t", " z")), (3, text("u", " z")), (None, text("v")), (None, text("v", " z")), (7, text("lone"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_links"]) for r in near_dup.join(docs).collect())
    assert got == [(0, 1), (0, 1), (1, 1), (1, 1), (2, 1), (3, 1), (7, 0)]
    assert len({r["class_id"] for r in near_dup.join(docs).collect()}) == 4
    kept = near_dup.keep_one(spark, docs.withColumns({"id": F.lit("i"), "h": F.lit("h"), "row": F.lit("r")}), FOLDER).collect()
    assert sorted((r["doc_id"] or 0, r["text"][0], r["id"], r["h"], r["row"]) for r in kept) == [(0, "v", "i", "h", "r"), (1, "t", "i", "h", "r"), (1, "u", "i", "h", "r"), (7, "l", "i", "h", "r")]


def smith_waterman(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_against_brute_force():
    rng = random.Random(1)
    pairs = [([rng.randrange(1, 4) for _ in range(rng.randrange(1, 9))], [rng.randrange(1, 4) for _ in range(rng.randrange(1, 12))]) for _ in range(80)]
    got = decontamination.align([(np.array(a, np.uint64), np.array(b, np.uint64)) for a, b in pairs])
    assert got.tolist() == [smith_waterman(a, b) for a, b in pairs]


def test_decontamination(spark, odd, texts):
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.op8_decontamination(spark, FOLDER).collect()}
    items = [(r["item_id"], r["text"]) for r in table(spark, FOLDER, "benchmark").collect()]
    want = {(i, k) for i, t in texts for k, b in items if b in t}
    assert want and want <= got and len(got) <= len(want) * 1.05
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**5)}" for _ in range(40)]
    edited = [w if rng.random() > 0.15 else "edit" for w in words]
    docs = spark.createDataFrame([(1, "x y z " + " ".join(edited) + " end"), (2, "nothing of it"), (3, None), (4, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(words)), (10, None), (11, ""), (12, "tiny")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()] == [(1, 9)]
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0 and decontamination.leaks(odd, bench).count() == 0
    kept = decontamination.drop_leaks(spark, table(spark, FOLDER, "documents"), FOLDER)
    assert kept.count() == 1000 - len({i for i, _ in got})
    # Each row is judged by its own text: leaks without an id go, clean rows that share an id with a leak stay.
    leak = next(t for i, t in texts if any(i == d for d, _ in want))
    rows = spark.createDataFrame([(None, leak, "a"), (1, leak, "b"), (1, "nothing of it", "c"), (1, leak, "d"), (None, None, "e")], "doc_id long, text string, item_id string").withColumn("score", F.lit(1))
    assert sorted(r["item_id"] for r in decontamination.drop_leaks(spark, rows, FOLDER).collect()) == ["c", "e"]
    assert decontamination.drop_leaks(spark, rows.limit(0), FOLDER).count() == 0
    # Repeated documents and repeated items each have their own rows, also when the test set comes in chunks.
    twice = decontamination.leaks(docs.unionByName(docs), bench.unionByName(bench))
    assert sorted((r["doc_id"], r["item_id"]) for r in twice.collect()) == [(1, 9)] * 4
    many, decontamination.ITEM_WORDS = decontamination.ITEM_WORDS, 10
    try:
        assert [(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()] == [(1, 9)]
        assert decontamination.clean(docs, bench).count() == 3
    finally:
        decontamination.ITEM_WORDS = many


def test_edited_copies_against_brute_force(spark):
    """Every document whose alignment reaches 0.6 is found, with its score, though each edited copy is the only one."""
    rng = random.Random(8)
    items = [[f"w{rng.randrange(3000 if i % 2 else 30)}" for _ in range(rng.randrange(15, 60) if i < 60 else rng.randrange(1, 15))] for i in range(90)]
    items[0] = "a0 a1 a2 a3 a4 a5 a6 a7".split()
    docs = [["x", *items[0][:3], "edit", *items[0][4:], "y"]]
    for w in items:
        for rate in (0.1, 0.2, 0.3):
            copy = [x for v in w for x in rng.choice(([v], [v, "new"], ["old"], [])) * (rng.random() < rate) or [v]]
            docs.append([f"w{rng.randrange(3000)}" for _ in range(rng.randrange(9))] + copy + ["the", "end"])
    known: dict[str, int] = {}
    code = [np.array([known.setdefault(x, len(known)) for x in t], np.uint64) for t in items + docs]
    scores = [decontamination.align([(code[k], d) for k in range(len(items))]) for d in code[len(items) :]]
    want = {(d, k): s / (2 * len(w)) for d, row in enumerate(scores) for k, (w, s) in enumerate(zip(items, row.tolist(), strict=True)) if s >= 1.2 * len(w) - 1e-9}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    table_of = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(docs)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.leaks(table_of, bench).collect()}
    assert got == want and (0, 0) in want and len(want) > 150
    few, decontamination.HITS = decontamination.HITS, 1  # hits in parts give the same passages
    try:
        mine, whole = decontamination.Items.of([(k, " ".join(w), 1) for k, w in enumerate(items)]), decontamination.Words(pa.array([" ".join(t) for t in docs]), plain=True)
        parts = decontamination.passages(mine, whole.hashes, whole.ptr)
    finally:
        decontamination.HITS = few
    assert sorted(parts) == sorted(decontamination.passages(mine, whole.hashes, whole.ptr))


def test_language(spark, odd):
    truth = {r["doc_id"]: r["lang"] for r in table(spark, FOLDER, "documents").collect()}
    got = langid.op9_langid(spark, FOLDER).collect()
    assert len(got) == 1000 and all(r["held_out"] == (remainder(r["doc_id"], 4) == 2) for r in got)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]) > 0.99
    model = langid.train(table(spark, FOLDER, "documents"), F.lit(True), per_language=30)
    found = sorted((r["doc_id"] or 0, r["lang_pred"]) for r in langid.predict(odd, model).collect())
    assert [p for i, p in found if i in (1, 2, 7, 8)] == ["und"] * 4 and len(found) == 10
    assert set(langid.LanguageModel([], np.zeros((2, 0)), np.zeros((0, 0))).predict(pa.array(["a"]))[0]) == {"und"}


def test_every_byte_of_long_words_is_read():
    """Words that differ only after their first 16 bytes differ; pieces cover every word, wherever they are cut."""
    from webweft.llm.textvec import Words

    texts = pa.array(["a" * 40 + "b" * 40 + "c" * 40, "a" * 40 + "d" * 40 + "c" * 40, "short words", "x" * 17, "", "中文没有空格的很长的句子" * 9], pa.large_string())
    words = Words(texts)
    cut = words.pieces()
    assert (cut.ends - cut.starts).max() == 16 and cut.ptr[3] - cut.ptr[2] == 2
    for a, b, i in zip(words.starts, words.ends, range(len(words.starts)), strict=True):
        inside = [(s, e) for s, e in zip(cut.starts, cut.ends, strict=True) if a <= s and e <= b]
        assert {k for s, e in inside for k in range(s, e - 2)} == set(range(a, max(a + 1, b - 2))), i
    again = Words(pa.array([bytes(words.data[s:e]).decode("latin-1") for s, e in zip(cut.starts[:8], cut.ends[:8], strict=True)], pa.large_string()))
    assert cut.hashes[:8].tolist() == again.hashes.tolist()
    features = langid.word_features(cut, np.arange(len(cut.hashes)))
    first, second = (set(features[cut.ptr[i] : cut.ptr[i + 1]].ravel().tolist()) for i in (0, 1))
    assert first != second
    model = langid.fit([("a" * 40 + "b" * 40 + " more of it " * 9, "one"), ("a" * 40 + "d" * 40 + " more of it " * 9, "two")] * 20, steps=40)
    assert model.predict(texts[:2])[0] == ["one", "two"]


def test_forward_backward_by_words_equals_segments():
    rng = np.random.default_rng(1)
    emission, trans, ptr = rng.standard_normal((400, 5)), rng.standard_normal((5, 5)), np.array([0, 130, 130, 131, 400])
    assert np.allclose(langid._walked_sums(emission, ptr, trans), langid.marginal_sums(emission, ptr, trans), atol=1e-8)
    assert langid._walked_sums(np.zeros((0, 5)), np.array([0, 0]), trans).tolist() == [[0] * 5]


@pytest.mark.parametrize("many", [1, 2, 200])
def test_every_language_is_learned(many):
    """However few words a language has; a document of one word is enough."""
    rng = random.Random(many)
    words = {f"l{c:03d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöüéñ", k=7)) for _ in range(1 if c == 0 else 12)] for c in range(many)}
    model = langid.fit([(" ".join(w), lang) for lang, w in words.items() for _ in range(2)], steps=60 if many < 9 else 25)
    assert model.languages == list(words)
    found, score = model.predict(pa.array([" ".join(w) for w in words.values()]))
    assert found == list(words) and (score > 1 / many - 1e-9).all()


def test_small_language_beside_large_ones(spark):
    """Five short texts of a language that only they have, beside the small table's four languages; no text at all."""
    docs = table(spark, FOLDER, "documents").filter("doc_id < 400").select("doc_id", "text", "lang")
    small = [(100_000 + i, f"hyvää huomenta kaikille ystäville {w}", "fi") for i, w in enumerate(("tänään", "huomenna", "eilen", "yöllä", "aamulla"))]
    model = langid.train(docs.unionByName(spark.createDataFrame(small, docs.schema)), F.lit(True), per_language=60)
    assert "fi" in model.languages and model.predict(pa.array([t for _, t, _ in small]))[0] == ["fi"] * 5
    empty = langid.train(docs.limit(0), F.lit(True))
    assert [r["lang_pred"] for r in langid.predict(docs.limit(1), empty).collect()] == ["und"] and langid.predict(docs.limit(0), model).count() == 0


def test_forward_backward_against_brute_force():
    rng = np.random.default_rng(0)
    emission, trans, ptr = rng.standard_normal((150, 3)), rng.standard_normal((3, 3)), np.array([0, 0, 1, 130, 150])
    got = langid.marginal_sums(emission, ptr, trans)
    for d, (a, b) in enumerate(zip(ptr, ptr[1:])):
        e = np.exp(emission[a:b])
        f, back = np.zeros_like(e), np.ones_like(e)
        for s in range(b - a):
            f[s] = (f[s - 1] @ np.exp(trans) if s else np.full(3, 1 / 3) @ np.exp(trans)) * e[s]
            f[s] /= f[s].sum()
        for s in range(b - a - 2, -1, -1):
            back[s] = np.exp(trans) @ (e[s + 1] * back[s + 1])
            back[s] /= back[s].sum()
        p = f * back
        want = (p / p.sum(1, keepdims=True)).sum(0) if b > a else np.zeros(3)
        assert np.allclose(got[d], want, atol=1e-8)


def test_token_files(spark, odd, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start = 0
    got = {r["doc_id"]: r for r in token_files.op10_token_files(spark, FOLDER).collect()}
    for i, t in sorted(texts):
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = sorted(token_files.read(token_files.write(odd, path)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 3, 4, 5, 6, 7, 8]
    sizes = {(r["doc_id"], r["text"] or ""): [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in odd.collect()}
    for (i, t), ids in sizes.items():
        assert [r["ids_crc32"] for r in rows if r["doc_id"] == i][0] == zlib.crc32(np.array(ids, "<u4").tobytes()), t[:20]
    same = spark.createDataFrame([(None, f"t {i} x") for i in range(200)] + [(1, "r")] * 100, "doc_id long, text string")
    starts = sorted((r["start"], r["n_tokens"]) for r in token_files.read(token_files.write(same, path)).collect())
    assert len(starts) == 300 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    encoder = token_files.Encoder(path)
    encoder.cuts = False
    assert encoder.encode(pa.array(["a b"]))[0].tolist() == [*library.encode("a b", add_special_tokens=False).ids, 2]
    import struct

    segment = token_files.write(same, path).orderBy("before").first()
    assert struct.unpack_from("<III", segment["bytes"])[:2] == (segment["n_ids"], len(segment["lengths"]))
    assert token_files.read(token_files.write(odd.limit(0), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


def test_patched_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 5000):
        for ids in (rng.integers(0, 50000, n), rng.integers(0, 3, n) + (rng.random(n) < 0.05) * 40000, np.full(n, 7), rng.integers(0, 1 << 32, n)):
            ids = ids.astype(np.uint32)
            data = token_files.pack(ids)
            assert (token_files.unpack(data) == ids).all()
            if n > 300:
                assert (token_files.unpack_block(data, 1) == ids[256:512]).all()
