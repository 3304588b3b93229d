"""HTML extraction by host suffix arrays.

A page becomes a stream of tokens: the words of its blocks, with a mark at each border of a block. Markup is the prior:
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments that say what they are
never enter the stream. The streams of a host's pages are concatenated and their suffixes sorted up to RUN tokens
(prefix doubling); neighbours in that order that share RUN tokens and come from distinct pages are parts of a repeated
substring, and any longer repeated substring is a chain of such parts. The array is sparse: it keeps suffixes at the
borders of blocks, and of every GAP others in a row the one of the least hash, which two pages choose alike where they
are alike. So every repeated substring of RUN + GAP - 1 tokens is met (and whole blocks of RUN - 2 words), and of one
that begins or ends within a block at most GAP - 1 words at that end are not covered. On how many pages of the host a
part stands decides:

- outside an article, what stands on two pages is boilerplate;
- inside an article (or main) element, what stands on MANY pages and on at least SHARE of the host's, and is no heading;
- a text that repeats nearly whole is a copy of another page's, not boilerplate around a text of its own: of an article
  covered to COPIED nothing goes, and a page without an article that is covered to COPIED_PAGE is judged as articles are.

Covered boilerplate is removed word by word and the unique runs are kept. Of a block that is covered in part only
stretches of RUN words or more go.

A host of more than about PAGES pages or BLOCK_CHARS characters is cut into blocks, by a hash of the page, so that its
pages lie in many tasks. The hashes of all parts of such hosts are exchanged: they are met by host and hash, and each
block is told of its parts on how many pages of the host they stand. So neither blocks nor the number of partitions
change a result. Pages are shuffled as compressed text of their blocks, not as html.

Defined cases: null and empty html give an empty text; a page cut off in a tag, comment or reference is read up to
there; a page alone on its host has no repeated runs and is judged by its markup; repeated rows are pages of their own;
a url without a host belongs to the host ''. Other columns than page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count, groupby, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, small_or_not, table
from .textvec import mix

#: Tokens (words and block borders) that pages must share in a row.
RUN = 8
#: Of so many suffixes in a row one stays in the array.
GAP = 6
#: Inside an article a run must stand on so many pages, and on this share of the host's.
MANY, SHARE = 3, 0.5
#: Share of an article, and of a page without one, from which on it is a copy.
COPIED, COPIED_PAGE = 0.5, 0.9
#: Pages and characters of a suffix array.
PAGES, BLOCK_CHARS = 256, 2_400_000
#: Run hashes that a task holds before it hands them on.
HELD = 2_000_000
#: Words that a task keeps from one block of pages to the next.
KNOWN = 500_000
#: Parts of a host's run hashes that meet in one place each, at most; a host of fewer blocks has as many parts as blocks.
BUCKETS = 4096
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|iframe|object)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z|<\Z", re.S | re.I)
#: Elements that never hold main text.
FURNITURE = frozenset("head title nav footer aside form button select option menu dialog header".split())
CONTENT = frozenset(("article", "main"))
#: Elements around everything: their classes tell of the page, not of what is in them.
AROUND = frozenset(("html", "body", "article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr del img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that a start tag ends.
ENDS = {
    "li": frozenset(("li", "p")),
    "dt": frozenset(("dt", "dd", "p")),
    "dd": frozenset(("dt", "dd", "p")),
    "option": frozenset(("option",)),
    "tr": frozenset(("tr", "td", "th", "p")),
    "td": frozenset(("td", "th", "p")),
    "th": frozenset(("td", "th", "p")),
} | {t: frozenset(("p",)) for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
ROLE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Names of a class, id or role that mark furniture, and words that may stand beside them in a name of several words.
FURNITURE_NAMES = frozenset("ad ads advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets related share sharing social cookie cookies consent notice newsletter subscribe popup modal comment comments disqus replies complementary contentinfo search toolbar".split())
BESIDE = frozenset("site page main top bottom left right global primary secondary bar box list area section block wrapper container inner posts links form signup slot unit buttons icons link item".split())
#: Of an inline element these names say nothing: code is marked up with them too.
NOT_INLINE = frozenset(("comment", "comments", "search", "header"))
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
NOT_SHOWN = re.compile(r"\bstyle\s*=\s*[\"'][^\"']*\bdisplay\s*:\s*none", re.I)
PART = re.compile(r"[-_]+")
PLAIN, ARTICLE, OUT, HEADING = 0, 1, 2, 3
#: The mark at a block's border.
BORDER = "\n"


def _names_furniture(name: str) -> bool:
    if name in FURNITURE_NAMES:
        return True
    words = [w for w in PART.split(name) if w]
    return len(words) > 1 and not FURNITURE_NAMES.isdisjoint(words) and all(w in FURNITURE_NAMES or w in BESIDE for w in words)


def _marks_furniture(attributes: str, but: frozenset[str] = frozenset()) -> bool:
    return any(name not in but and _names_furniture(name) for a, b, c in ROLE.findall(attributes) for name in (a or b or c).lower().split()) if attributes else False


def _is_hidden(attributes: str) -> bool:
    if not attributes:
        return False
    return bool("hidden" in attributes.lower() and HIDDEN.search(QUOTED.sub("", attributes)) or NOT_SHOWN.search(attributes))


def blocks(page: str) -> list[tuple[int, str]]:
    """(region, text) of the blocks of a page in order, character references decoded and white space joined."""
    out: list[tuple[int, str]] = []
    open_tags: list[tuple[str, bool]] = []
    text: list[str] = []
    at = furniture = articles = 0
    #: The inline element that is left out, and how many of its name are open in it.
    left_out, depth = "", 0

    def flush() -> None:
        nonlocal left_out
        left_out = ""
        joined = " ".join(html_lib.unescape("".join(text)).split())
        text.clear()
        if joined:
            inside = HEADING if open_tags and open_tags[-1][0] in HEADINGS else ARTICLE
            out.append((OUT if furniture else inside if articles else PLAIN, joined))

    def close() -> str:
        nonlocal furniture, articles
        tag, marks = open_tags.pop()
        furniture -= marks
        articles -= tag in CONTENT
        return tag

    for m in TOKEN.finditer(page):
        if m.start() > at and not left_out:
            text.append(page[at : m.start()])
        at = m.end()
        name = (m[3] or m[1] or "").lower()
        if name in INLINE and not left_out and not m[2] and name not in VOID and (_marks_furniture(m[4], NOT_INLINE) or _is_hidden(m[4])):
            left_out, depth = name, 1
        elif name and name == left_out:
            depth += -1 if m[2] else 1
            left_out = left_out if depth else ""
        if not name or name in INLINE:
            continue
        flush()
        if m[1]:
            continue
        if not m[2]:
            while open_tags and open_tags[-1][0] in ENDS.get(name, ()):
                close()
            if name in VOID:
                continue
            # A header element inside an article is the article's own heading.
            marks = (name in FURNITURE and not (name == "header" and articles)) or (name not in AROUND and (_marks_furniture(m[4]) or _is_hidden(m[4])))
            open_tags.append((name, marks))
            furniture += marks
            articles += name in CONTENT
        elif any(t == name for t, _ in open_tags):
            while close() != name:
                pass
    if not left_out:
        text.append(page[at:])
    flush()
    return out


def pack(page: str | None) -> bytes:
    """The blocks that enter the stream, compressed."""
    lines = [f"{region}{text}" for region, text in blocks(page or "") if region != OUT]
    return zstandard.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 3)


def unpack(packed: bytes) -> list[tuple[int, list[str]]]:
    """(region, words) of each block."""
    text = zstandard.decompress(packed).decode("utf-8", "surrogatepass")
    return [(int(line[0]), line[1:].split(" ")) for line in text.split("\n")] if text else []


def stream(page: list[tuple[int, list[str]]]) -> list[str]:
    """The tokens of a page: words, and a border before each block and after the last."""
    return [t for _, words in page for t in (BORDER, *words)] + [BORDER] if page else []


def parts(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the suffixes that have `run` tokens in their page, sorted by these and the page, and the
    number of each one's group: suffixes of one group share their first `run` tokens."""
    n = len(tokens)
    if n < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, rank = np.unique(tokens, return_inverse=True)
    rank, length = rank.astype(np.int64) + 1, 1
    while length < run:
        step = min(length, run - length)
        after = np.zeros(n, np.int64)
        after[: n - step] = np.where(page[step:] == page[: n - step], rank[step:], 0)
        _, rank = np.unique(rank * (n + 2) + after, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        length += step
    whole = np.zeros(n, bool)
    whole[: n - run + 1] = page[run - 1 :] == page[: n - run + 1]
    suffix_array = np.lexsort((page, rank))
    suffix_array = suffix_array[whole[suffix_array]]
    ranks = rank[suffix_array]
    return suffix_array, np.cumsum(np.append(False, ranks[1:] != ranks[:-1])) if len(ranks) else ranks


def pages_of(suffix_array: np.ndarray, group: np.ndarray, page: np.ndarray) -> np.ndarray:
    """On how many pages each group stands."""
    if not len(group):
        return np.zeros(0, np.int64)
    p = page[suffix_array]
    fresh = np.append(True, (group[1:] != group[:-1]) | (p[1:] != p[:-1]))
    return np.bincount(group[fresh])


def covered(starts: np.ndarray, n: int, run: int = RUN) -> np.ndarray:
    """Which of n tokens lie in a run from one of these starts on."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + run, -1)
    return np.cumsum(change[:n]) > 0


def stretches(drop: np.ndarray, word: np.ndarray, least: int = RUN) -> np.ndarray:
    """drop, without stretches of fewer than `least` words that are not a whole block: a shared beginning is no boilerplate."""
    edge = np.diff(np.concatenate([[False], drop, [False]]).astype(np.int8))
    out = drop.copy()
    for a, b in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist(), strict=True):
        whole = not word[a - 1] and (b == len(word) or not word[b])
        if b - a < least and not whole:
            out[a:b] = False
    return out


class Words:
    """Numbers of tokens, and their hashes by number, the same in every process; each token is hashed once."""

    def __init__(self):
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.hashes = np.zeros(1 << 12, np.uint64)
        self.hashed = 0

    def numbers(self, tokens: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))
        if new := len(self.number) - self.hashed:
            fresh = [*islice(reversed(self.number), new)][::-1]
            digests = b"".join([hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in fresh])
            if len(self.number) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros(len(self.number), np.uint64)])
            self.hashes[self.hashed : len(self.number)] = np.frombuffer(digests, "<u8")
            self.hashed = len(self.number)
        return out


def run_hashes(h: np.ndarray, run: int = RUN) -> np.ndarray:
    """A hash of each run of `run` words in a row, from the hashes of the words."""
    if len(h) < run:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - run + 1, np.uint64)
    for k in range(run):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - run + 1 + k])
    return out


def anchors(hashes: np.ndarray, border: np.ndarray, run: int = RUN, gap: int = GAP) -> np.ndarray:
    """Where the runs of a page stay in the array. hashes: of all its runs; border: which tokens are borders."""
    keep = np.zeros(len(hashes), bool)
    if not len(hashes):
        return keep
    size = min(gap, len(hashes))
    in_a_row = np.lib.stride_tricks.sliding_window_view(hashes, size)
    keep[in_a_row.argmin(1) + np.arange(len(in_a_row))] = True
    at = np.flatnonzero(border)
    # Runs from a border or the word after it on, and up to a border or the word before it.
    for first in (at, at + 1, at - run + 1, at - run):
        keep[first[(first >= 0) & (first < len(hashes))]] = True
    return keep


def anchored(tokens: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of a page's stream of numbers, and which of them stay in the array."""
    h = run_hashes(words.hashes[tokens])
    return h, anchors(h, tokens == words.number[BORDER])


def main_texts(pages: list[list[tuple[int, list[str]]]], host_pages: int, told: tuple[np.ndarray, np.ndarray] | None = None, words: Words | None = None) -> list[str]:
    """Main texts of some pages of one host, given as in `unpack`.

    told: of a host of several blocks, the sorted hashes of the runs that stand on several of its pages, and on how many.
    words: numbers of tokens that are known from other pages.
    """
    words = words or Words()
    streams = [stream(p) for p in pages]
    numbered = [words.numbers(s) for s in streams]
    tokens = np.concatenate([np.zeros(0, np.int64), *numbered])
    page = np.repeat(np.arange(len(pages)), [len(s) for s in streams])
    suffix_array, group = parts(tokens, page)
    hashed = [anchored(s, words) for s in numbered]
    fill = [np.zeros(len(s) - len(h), np.uint64) for s, (h, _) in zip(numbered, hashed, strict=True)]
    at = np.concatenate([np.zeros(0, np.uint64), *(x for (h, _), f in zip(hashed, fill, strict=True) for x in (h, f))])
    stays = np.concatenate([np.zeros(0, bool), *(x for (_, keep), f in zip(hashed, fill, strict=True) for x in (keep, f > 0))])
    if len(group):
        suffix_array, group = suffix_array[stays[suffix_array]], group[stays[suffix_array]]
        group = np.unique(group, return_inverse=True)[1]
    many = pages_of(suffix_array, group, page)
    if told is not None and len(group):
        # One hash for each group says how often its run stands on the whole host.
        h = at[suffix_array[np.append(True, group[1:] != group[:-1])]]
        place = np.minimum(np.searchsorted(told[0], h), max(len(told[0]) - 1, 0))
        many = np.where(told[0][place] == h, told[1][place], 1) if len(told[0]) else np.ones(len(h), np.int64)
    often = max(MANY, int(np.ceil(SHARE * host_pages)))
    twice, everywhere = (covered(suffix_array[(many >= least)[group]], len(tokens)) for least in (2, often))
    out, at = [], 0
    for blocks_of, flat in zip(pages, streams, strict=True):
        sizes = np.array([len(own) + 1 for _, own in blocks_of], int)
        region = np.repeat(np.array([r for r, _ in blocks_of], int), sizes)
        word = np.ones(len(region), bool)
        word[np.cumsum(sizes) - sizes] = False
        two, all_over = twice[at : at + len(region)], everywhere[at : at + len(region)]
        article = word & (region == ARTICLE)
        plain = word & (region == PLAIN)
        drop = plain & two
        if not article.any() and drop.sum() >= COPIED_PAGE * plain.sum():
            drop = plain & all_over if (plain & all_over).sum() < COPIED * plain.sum() else np.zeros_like(drop)
        if (article & all_over).sum() < COPIED * article.sum():
            drop |= article & all_over
        drop = stretches(drop, word)
        out.append(" ".join(compress(flat, (word & ~drop).tolist())))
        at += len(region) + 1 if blocks_of else 0
    return out


def _counted_runs(rows: DataFrame) -> DataFrame:
    """host, block and found (hashes of the block's runs that stand on two pages of the host, and on how many)."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        held: dict[tuple[str, int, int], list[np.ndarray]] = {}

        def done() -> pa.RecordBatch:
            out = []
            for (host, n, block), pages in held.items():
                h, many = np.unique(np.concatenate(pages), return_counts=True)
                bucket = (h % np.uint64(min(n, BUCKETS))).astype(np.int64)
                order = np.lexsort((many > 1, bucket))
                for mine in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                    if len(mine):
                        # Runs of one page first; counts stand beside the others only.
                        counts = many[mine][many[mine] > 1].astype(np.uint32)
                        out.append((host, block, int(bucket[mine[0]]), h[mine].tobytes(), counts.tobytes()))
            held.clear()
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["host", "block", "bucket", "runs", "counts"])

        size = 0
        for batch in batches:
            for html, host, n, block in zip(*(batch.column(c).to_pylist() for c in ("html", "host", "n", "block")), strict=True):
                words = [(r, t.split(" ")) for r, t in blocks(html or "") if r != OUT]
                h, keep = anchored(known.numbers(stream(words)), known)
                h = np.unique(h[keep])
                held.setdefault((host, n, block), []).append(h)
                size += len(h)
                if len(known.number) > HELD:
                    known = Words()
                if size > HELD:
                    yield done()
                    size = 0
        yield done()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answers(rows):
            runs = [np.frombuffer(r[3], np.uint64) for r in rows]
            counts = [np.frombuffer(r[4], np.uint32) for r in rows]
            each = np.concatenate([x for h, c in zip(runs, counts, strict=True) for x in (np.ones(len(h) - len(c)), c)])
            every, of = np.unique(np.concatenate(runs), return_inverse=True)
            total = np.bincount(of, weights=each).astype(np.uint32)
            ends = np.cumsum([len(h) for h in runs])
            for block in {r[1] for r in rows}:
                mine = np.unique(np.concatenate([of[e - len(h) : e] for h, e, r in zip(runs, ends, rows, strict=True) if r[1] == block]))
                mine = mine[total[mine] > 1]
                yield rows[0][0], block, every[mine].tobytes(), total[mine].tobytes()

        def sorted_rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("host", "block", "bucket", "runs", "counts")), strict=True)

        for _, rows in groupby(sorted_rows(), key=lambda r: (r[0], r[2])):
            found = [a for a in answers(list(rows)) if a[2]]
            if found:
                kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], ["host", "block", "runs", "counts"])

    sent = rows.filter("n > 1").select("html", "host", "n", "block").mapInArrow(hashes, "host string, block long, bucket long, runs binary, counts binary")
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(ranges, "host", "bucket").sortWithinPartitions("host", "bucket").mapInArrow(meet, "host string, block long, runs binary, counts binary")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    spark = pages.sparkSession
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    rows = pages.select("page_id", "url", "html", host.alias("host"), F.xxhash64("page_id", "url", "html").alias("dealt"))
    n = F.ceil(F.greatest(F.count("*") / PAGES, F.sum(F.coalesce(F.length("html"), F.lit(0))) / BLOCK_CHARS))
    large = rows.groupBy("host").agg(n.cast("long").alias("n"), F.count("*").alias("host_pages")).filter("n > 1")
    rows = rows.join(small_or_not(large), "host", "left").withColumn("n", F.coalesce("n", F.lit(1).cast("long"))).withColumn("block", F.expr("pmod(dealt, n)"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([pack(h) for h in batch.column("html").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "html"), texts], [*(c for c in batch.schema.names if c != "html"), "packed"])

    small = rows.select("page_id", "url", "host", "block", "host_pages", "dealt", "html").mapInArrow(packed, "page_id long, url string, host string, block long, host_pages long, dealt long, packed binary")
    both = small.unionByName(_counted_runs(rows), allowMissingColumns=True)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The answers to a block, without dealt, come before its pages.
    dealt = both.repartition(ranges, "host", "block").sortWithinPartitions("host", "block", F.col("packed").isNotNull(), "dealt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, told = None, [], []
        words = Words()

        def done() -> pa.RecordBatch:
            nonlocal words
            if len(words.number) > KNOWN:
                words = Words()
            answer = None
            if held[0][5] is not None:
                runs, counts = (np.concatenate([np.zeros(0, t), *(np.frombuffer(x[k], t) for x in told)]) for k, t in ((0, np.uint64), (1, np.uint32)))
                order = np.argsort(runs)
                answer = runs[order], counts[order].astype(np.int64)
            texts = main_texts([unpack(r[4]) for r in held], held[0][5] or len(held), answer, words)
            columns = [pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "host", "block", "packed", "host_pages", "runs", "counts")), strict=True):
                if row[2:4] != key:
                    if held:
                        yield done()
                    key, held, told = row[2:4], [], []
                if row[4] is not None:
                    held.append(row)
                else:
                    told.append(row[6:8])
        if held:
            yield done()

    return dealt.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract(table(spark, sf_dir, "pages"))
