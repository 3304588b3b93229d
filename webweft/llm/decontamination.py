"""Benchmark decontamination: rare n-gram seeds join passages to test items, then Smith-Waterman alignment.

An alignment (words; match 2, mismatch -1, gap -1) that reaches LEAST of an item's perfect score has a least number of
word pairs in a row in common with the item, and spans a bounded number of words (`Bounds`). One pass over all
documents counts in how many documents each pair stands; an item's most frequent pairs, at most half of what that
number allows, are not used as seeds and the number is lowered by as many. A second pass finds in each document the windows of the
greatest span with that many seeds of an item, joins those that overlap into passages and aligns the whole item with
each. No alignment from LEAST on is lost. The best score of an item in a document, divided by the item's perfect score, is reported.

The test set is broadcast in chunks: its distinct items are dealt into as many chunks as there are ITEM_WORDS words, by
a hash, so that a chunk has about ITEM_WORDS words, one long item apart. Each chunk reads the documents twice. One count
for each seed of a chunk comes to the driver. Documents are never shuffled.

Defined cases: null and empty texts and items match nothing; items so short that pairs prove nothing are seeded by
single words; repeated items each get their own rows; repeated documents each get their own rows; an empty test set
gives an empty result. The stage judges each row by its own text, whatever its doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, table, texts_of
from .textvec import Words

GRAM = 2
ITEM_WORDS = 2_000_000
#: Seed hits held at a time; more are found in parts.
HITS = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST = 0.6


@dataclass
class Bounds:
    """What any alignment of score S = least x 2 x words of the item must have.

    With m matches and e mismatches and gaps, 2m - e >= S and m <= the item's words. It spans at most m + e <= 3m - S
    words of the document, and has at least m - e - 1 >= S - m - 1 pairs of matches in a row, or m >= S / 2 matches.
    """

    gram: int
    need: int
    span: int

    @staticmethod
    def of(size: int, least: float) -> Bounds:
        score = least * MATCH * size - 1e-9
        pairs = math.ceil(score) - size - 1
        gram = GRAM if pairs >= 1 else 1
        return Bounds(gram, max(1, pairs if gram == GRAM else math.ceil(score / MATCH)), 3 * size - math.ceil(score))


@dataclass
class Items:
    """Test items (each with how often it stands in the test set) as word hashes with their bounds, and seeds sorted by
    hash: item and place of each."""

    ids: list[tuple]
    words: list[np.ndarray]
    gram: np.ndarray
    need: np.ndarray
    span: np.ndarray
    seed: np.ndarray
    item: np.ndarray
    place: np.ndarray

    @staticmethod
    def of(rows: list[tuple], least: float = LEAST) -> Items:
        """rows: item_id, text, and how often the item stands in the test set."""
        words = Words(pc.utf8_lower(pa.array([r[1] or "" for r in rows], pa.large_string())), plain=True)
        per = [((r[0], r[2]), words.hashes[a:b]) for r, a, b in zip(rows, words.ptr, words.ptr[1:], strict=False) if b > a]
        bounds = [Bounds.of(len(w), least) for _, w in per]
        seeds = [_seeds(w, b.gram) for (_, w), b in zip(per, bounds, strict=True)]
        seed = np.concatenate([*seeds, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(per)), [len(s) for s in seeds])
        place = np.concatenate([*(np.arange(len(s)) for s in seeds), np.zeros(0, int)]).astype(np.int64)
        order = np.argsort(seed, kind="stable")
        gram, need, span = (np.array([getattr(b, f) for b in bounds], np.int64) for f in ("gram", "need", "span"))
        return Items([i for i, _ in per], [w for _, w in per], gram, need, span, seed[order], item[order], place[order])

    def rare(self, df: dict[int, int]) -> Items:
        """Without each item's most frequent seeds, at most half of what its need allows; the need falls by as many."""
        count = np.array([df.get(int(s.astype(np.int64)), 0) for s in self.seed], np.int64)
        drop = (self.need - 1) // 2
        order = np.lexsort((self.place, -count, self.item))
        rank = np.arange(len(order)) - np.searchsorted(self.item[order], self.item[order])
        keep = np.ones(len(order), bool)
        keep[order] = rank >= drop[self.item[order]]
        return self.part(keep, self.need - drop)

    def part(self, keep: np.ndarray, need: np.ndarray | None = None) -> Items:
        """With some of the seeds."""
        return Items(self.ids, self.words, self.gram, self.need if need is None else need, self.span, self.seed[keep], self.item[keep], self.place[keep])


def _seeds(w: np.ndarray, n: int = GRAM) -> np.ndarray:
    n = min(n, len(w))
    if not n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k]
    return h ^ h >> np.uint64(29)


def _grams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row of one document, and their first words' numbers."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1])
    return _seeds(hashes, n)[at], at


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Best Smith-Waterman scores of (item words, passage words) pairs, all pairs' anti-diagonals at once."""
    if not pairs:
        return np.zeros(0, int)
    n, m = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    a, b = np.zeros((len(pairs), n), np.uint64), np.zeros((len(pairs), m), np.uint64)
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)], b[i, : len(y)] = x, y
    real = np.arange(m) < np.array([len(y) for _, y in pairs])[:, None]  # padding matches nothing
    whole = np.arange(n) < np.array([len(x) for x, _ in pairs])[:, None]
    best = np.zeros(len(pairs), np.int32)
    # H of the two last anti-diagonals, indexed by the item's position (0: before it).
    two, one = np.zeros((len(pairs), n + 1), np.int32), np.zeros((len(pairs), n + 1), np.int32)
    for d in range(n + m - 1):
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        score = np.where((a[:, i] == b[:, d - i]) & whole[:, i] & real[:, d - i], MATCH, MISMATCH)
        now = np.zeros_like(one)
        now[:, i + 1] = np.maximum(0, np.maximum(two[:, i] + score, np.maximum(one[:, i], one[:, i + 1]) + GAP))
        best = np.maximum(best, now.max(1))
        two, one = one, now
    return best


def _first_hits(items: Items, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first number, count, word) for each word of the documents at which seeds begin: a range of seed numbers."""
    found = []
    for n in np.unique(items.gram):
        h, at = _grams(hashes, doc, int(n))
        low = np.searchsorted(items.seed, h, "left")
        some = np.flatnonzero(items.seed[np.minimum(low, len(items.seed) - 1)] == h) if len(items.seed) else np.zeros(0, int)
        found.append((low[some], np.searchsorted(items.seed, h[some], "right") - low[some], at[some]))
    low, many, at = (np.concatenate([x[k] for x in found] or [np.zeros(0, int)]) for k in range(3))
    order = np.argsort(at, kind="stable")
    return low[order], many[order], at[order]


def passages(items: Items, hashes: np.ndarray, ptr: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, item, start, end) of the passages, in words of all documents, that may hold an alignment.

    hashes: words of all documents; ptr: where each document's words begin, and the end.
    """
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    low, many, at = _first_hits(items, hashes, doc)
    if not len(at):
        return []
    if many.sum() > HITS and doc[at[0]] != doc[at[-1]]:
        middle = (doc[at[0]] + doc[at[-1]]) // 2
        if not np.any(doc[at] == middle):
            middle = doc[at[doc[at] < middle][-1]]
        cut = int(ptr[middle + 1])
        first = passages(items, hashes[:cut], ptr[: middle + 2])
        second = passages(items, hashes[cut:], ptr[middle + 1 :] - cut)
        return first + [(d + middle + 1, k, s + cut, e + cut) for d, k, s, e in second]
    if many.sum() > HITS and items.item.min() != items.item.max():
        middle = (items.item.min() + items.item.max()) // 2
        return passages(items.part(items.item <= middle), hashes, ptr) + passages(items.part(items.item > middle), hashes, ptr)
    number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    at = np.repeat(at, many)
    pair = doc[at] * len(items.words) + items.item[number]
    order = np.argsort(pair, kind="stable")  # places stay in order
    pair, at, number = pair[order], at[order], number[order]
    # Pairs with too few distinct places of the item can hold nothing.
    by_place = np.lexsort((number, pair))
    fresh = np.append(True, (np.diff(pair[by_place]) != 0) | (np.diff(number[by_place]) != 0))
    _, group = np.unique(pair, return_inverse=True)
    distinct = np.bincount(group[by_place][fresh])
    enough = distinct[group] >= items.need[items.item[number]]
    pair, at, number, group = pair[enough], at[enough], number[enough], group[enough]
    if not len(at):
        return []
    item = items.item[number]
    need, span, gram = items.need[item], items.span[item], items.gram[item]
    # A hit that begins an alignment has enough hits in the span from it on.
    line = group * (2 * len(hashes) + 3 * int(items.span.max()) + 4) + at
    until = np.searchsorted(line, line + span - gram, "right")
    out: list[tuple[int, int, int, int]] = []
    for i in np.flatnonzero(until - np.arange(len(line)) >= need).tolist():
        if len(set(number[i : until[i]].tolist())) < need[i]:
            continue
        d, k, reach = int(doc[at[i]]), int(item[i]), int(span[i])
        # The alignment holds this hit and the one that completes the need, so it lies in reach of both.
        start, end = max(int(ptr[d]), int(at[i + need[i] - 1] + gram[i]) - reach), min(int(ptr[d + 1]), int(at[i]) + reach)
        if out and out[-1][:2] == (d, k) and start < out[-1][3]:
            out[-1] = (d, k, min(start, out[-1][2]), max(end, out[-1][3]))
        else:
            out.append((d, k, start, end))
    return [x for x in out if _may_reach(items, x, hashes)]


def _may_reach(items: Items, found: tuple[int, int, int, int], hashes: np.ndarray) -> bool:
    """Whether some span of the passage has as many words of the item as the matches of an alignment (half its score)."""
    _, k, start, end = found
    w, need = items.words[k], -(-(3 * len(items.words[k]) - int(items.span[k])) // MATCH)
    same = np.concatenate([[0], np.cumsum(np.isin(hashes[start:end], w))])
    reach = min(int(items.span[k]), end - start)
    return bool((same[reach:] - same[: len(same) - reach]).max() >= need)


def _chunks(benchmark: DataFrame, least: float) -> Iterator[Items]:
    """The test set in chunks of about ITEM_WORDS words. There is always one."""
    rows = benchmark.groupBy("item_id", "text").agg(F.count("*").alias("n"))
    words = rows.agg(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")))).first()[0] or 0
    chunks = max(1, -(-int(words) // ITEM_WORDS))
    dealt = F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks))
    for c in range(chunks):
        yield Items.of([tuple(r) for r in rows.filter(dealt == c).collect()], least)


def leaks(documents: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, item_id, score (share of the perfect score), start and n_words of the aligned passage."""
    out = None
    for items in _chunks(benchmark, least):
        find = _finder(documents, items, least)

        def run(batches: Iterator[pa.RecordBatch], find=find) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    ids = part.column("doc_id").to_pylist()
                    rows = [(ids[d], item, *found) for d, (item, n), *found in find(part) for _ in range(n)]
                    columns = list(zip(*rows, strict=True)) or [()] * 5
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "score", "start", "n_words"])

        found = documents.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, score double, start long, n_words long")
        out = found if out is None else out.unionByName(found)
    return out


def clean(documents: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows, with all their columns, whose text holds no passage of the test set."""
    for items in _chunks(benchmark, least):
        find = _finder(documents, items, least)

        def run(batches: Iterator[pa.RecordBatch], find=find) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    keep = np.ones(part.num_rows, bool)
                    keep[[d for d, *_ in find(part)]] = False
                    yield part.filter(pa.array(keep))

        documents = documents.mapInArrow(run, documents.schema)
    return documents


def _finder(documents: DataFrame, items: Items, least: float):
    """A function for tasks: (row, item, score, start, words) of the best passage of each item in the texts of a batch."""
    sc = documents.sparkSession.sparkContext
    every, lengths = sc.broadcast(np.unique(items.seed)), np.unique(items.gram).tolist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(every.value), np.int64)
        for batch in batches:
            for part in slices(batch):
                words = Words(pc.utf8_lower(texts_of(part)), plain=True)
                doc = np.repeat(np.arange(len(part)), np.diff(words.ptr))
                for n in lengths:
                    h, first = _grams(words.hashes, doc, n)
                    at = np.minimum(np.searchsorted(every.value, h), len(total) - 1)
                    same = every.value[at] == h
                    total += np.bincount(np.unique(doc[first[same]] * len(total) + at[same]) % len(total), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(every.value[seen].astype(np.int64)), pa.array(total[seen])], ["seed", "n"])

    counted = documents.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    df = {r["seed"]: r["n"] for r in counted.collect()} if len(items.seed) else {}
    shared = sc.broadcast(items.rare(df))

    def find(part: pa.RecordBatch) -> list[tuple]:
        mine = shared.value
        words = Words(pc.utf8_lower(texts_of(part)), plain=True)
        found = passages(mine, words.hashes, words.ptr)
        # Pairs of like size together, so that padding stays small.
        found.sort(key=lambda x: (len(mine.words[x[1]]), x[3] - x[2]))
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for i in range(0, len(found), 512):
            some = found[i : i + 512]
            scores = align([(mine.words[k], words.hashes[s:e]) for _, k, s, e in some])
            for (d, k, s, e), x in zip(some, scores, strict=True):
                value = (float(x) / (MATCH * len(mine.words[k])), int(words.ptr[d]) - s, e - s)
                if value[0] >= least:
                    best[d, k] = max(best.get((d, k), value), value)
        return [(d, mine.ids[k], v, -s, n) for (d, k), (v, s, n) in sorted(best.items())]

    return find


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows whose text holds no passage of the test set."""
    small_batches(spark)
    return clean(docs, table(spark, sf_dir, "benchmark"))
