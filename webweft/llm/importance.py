"""Target-distribution importance resampling: hashed word n-grams, enumerated by word-id suffix arrays.

A block of texts becomes one sequence of word ids. Its suffix array, sorted to the depth of three words, lays equal
n-grams side by side: where neighbours share a prefix of n words (their LCP), the run is one distinct n-gram with all
its occurrences. Each run is hashed once, whatever its length. The first pass adds run lengths into counts of the
buckets; the second scatters the runs' buckets back to the words where they begin, and sums their gains by document.
Nothing but 10,000 counts a task is shuffled between the passes, and words never are.

Drawing: Gumbel noise from a hash of the id is added to the weight; ranks come from a range partitioning by score with
the counts of the ranges before, so that no task sees all rows.

Defined cases: null and empty texts and texts without words have no features and weight 0; a null doc_id counts as an
empty text in the noise and ranks before other ids on ties; repeated rows get equal weights and scores and ranks in a
row; very long texts make a block of their own; an empty table gives an empty result. Columns other than doc_id and
text are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices, small_batches, table, written

BUCKETS = 10_000
LONGEST = 3
#: A document takes part in the draw from so many words on; so many hundredths of those are drawn.
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Bytes of text in a suffix array: the more, the more often an n-gram is met again.
BLOCK_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The bytes of a word: digits, small letters, and all of a character outside ASCII.
_INK = np.zeros(256, bool)
_INK[48:58] = _INK[97:123] = _INK[128:] = True


def _zero_tables(longest: int) -> np.ndarray:
    """[n, k, v]: a CRC register with byte k = v (else 0) after n bytes of zero. A register is the xor of its bytes' parts."""
    by_byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        by_byte = np.where(by_byte & 1, by_byte >> 1 ^ np.uint32(0xEDB88320), by_byte >> 1)
    out = np.zeros((longest + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(longest):
        out[n + 1] = out[n] >> 8 ^ by_byte[out[n] & 255]
    return out


_ZEROS = _zero_tables(64)


def moved_on(register: np.ndarray, count: np.ndarray) -> np.ndarray:
    """CRC registers after so many bytes of zero: xor with another text's register from 0 gives that of both in a row."""
    out, left = register.copy(), count.copy()
    while (some := np.flatnonzero(left)).size:
        now, n = out[some], np.minimum(left[some], 64)
        out[some] = _ZEROS[n, 0, now & 255] ^ _ZEROS[n, 1, now >> 8 & 255] ^ _ZEROS[n, 2, now >> 16 & 255] ^ _ZEROS[n, 3, now >> 24]
        left[some] -= n
    return out


class SuffixArray:
    """The words of some texts, and their suffixes in the order of their first three words.

    data: words in small letters, each with one space behind it; at: where each begins (and the end); words: how many
    each text has; ids: (LONGEST, n) the word and those after it, 0 behind the end of a text; order: the suffix array.
    """

    def __init__(self, texts: list[bytes]):
        raw = _LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
        ink = _INK[raw]
        before = np.concatenate([[False], ink[:-1]])
        starts, ends = np.flatnonzero(ink & ~before), np.flatnonzero(~ink & before)
        raw[ends] = 32
        self.data = raw[ink | (~ink & before)]
        self.at = np.concatenate([[0], np.cumsum(ends - starts + 1)]).astype(np.int64)
        first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.words = np.diff(np.searchsorted(starts, first))
        n = len(starts)
        named = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(self.at), pa.py_buffer(self.data)]).dictionary_encode()
        own = named.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        # By id: the word's length, the register of a text that is the word, and that of a space and the word from 0.
        known = [w[:-1] for w in named.dictionary.to_pylist()]
        self.size = np.array([0, *map(len, known)], np.int64)
        alone = np.array([0, *(crc32(w, 0xFFFFFFFF) for w in known)], np.uint32) ^ np.uint32(0xFFFFFFFF)
        self.begun = moved_on(np.full(len(alone), 0xFFFFFFFF, np.uint32), self.size) ^ alone
        self.added = moved_on(np.full(len(alone), ~np.uint32(crc32(b" ", 0xFFFFFFFF)), np.uint32), self.size) ^ alone
        left = np.repeat(np.cumsum(self.words), self.words) - np.arange(n)  # words from here to the end of the text
        self.ids = np.zeros((LONGEST, n), np.int64)
        for k in range(LONGEST):
            self.ids[k, : max(n - k, 0)] = np.where(left[: max(n - k, 0)] > k, own[k:], 0)
        bits = len(self.size).bit_length()
        if bits * LONGEST < 64:
            key = np.zeros(n, np.int64)
            for row in self.ids:
                key = key << bits | row
            self.order = np.argsort(key)
        else:
            self.order = np.lexsort(self.ids[::-1])

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For n = 1, 2, 3: the places in `order` where a run of one n-gram begins, the runs' lengths, their buckets.

        The runs cover `order`; a run of suffixes that are shorter than n words has bucket -1.
        """
        n = len(self.order)
        new = np.zeros(n, bool)
        new[:1] = True
        for k in range(LONGEST):
            word = self.ids[k, self.order]
            new[1:] |= word[1:] != word[:-1]  # the LCP with the suffix before is k words at most
            heads = np.flatnonzero(new)
            words = self.ids[: k + 1, self.order[heads]]
            register = self.begun[words[0]]
            for next_word in words[1:]:
                register = moved_on(register, self.size[next_word] + 1) ^ self.added[next_word]
            yield heads, np.diff(np.append(heads, n)), np.where(words[k] > 0, (~register).astype(np.int64) % BUCKETS, -1)

    def counts(self) -> np.ndarray:
        """Occurrences of n-grams by bucket."""
        out = np.zeros(BUCKETS)
        for _, size, bucket in self.runs():
            out += np.bincount(bucket[bucket >= 0], size[bucket >= 0], BUCKETS)
        return out.astype(np.int64)

    def sums(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of n-grams, sum of their buckets' gains) of each text."""
        n = len(self.order)
        found, gain = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for _, size, bucket in self.runs():
            found[self.order] += np.repeat(bucket >= 0, size)
            gain[self.order] += np.repeat(np.where(bucket >= 0, gains[bucket], 0), size)
        last = np.cumsum(self.words)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], last])])
        return total(found), total(gain)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, SuffixArray]]:
    for batch in batches:
        for part in slices(batch, most=BLOCK_BYTES):
            yield part, SuffixArray(part.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist())


def bucket_counts(documents: DataFrame) -> DataFrame:
    """bucket and n: the n-grams of all documents by bucket; buckets without any are left out."""

    def run(batches):
        out = np.zeros(BUCKETS, np.int64)
        for _, block in _blocks(batches):
            out += block.counts()
        used = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(out[used])], ["bucket", "n"])

    return documents.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame) -> np.ndarray:
    """For each bucket the floor of 1000 times the log ratio of its smoothed shares in the target and in the raw texts."""
    s, t = ({r["bucket"]: r["n"] for r in counted.collect()} for counted in (bucket_counts(raw), bucket_counts(target)))  # BUCKETS rows
    total_s, total_t = sum(s.values()), sum(t.values())
    ratio = lambda b: float(t.get(b, 0) + 1) * float(total_s + BUCKETS) / (float(s.get(b, 0) + 1) * float(total_t + BUCKETS))
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(BUCKETS)], np.int64)


def weights(documents: DataFrame, table_of_gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(table_of_gains)  # BUCKETS numbers

    def run(batches):
        for part, block in _blocks(batches):
            found, gain = block.sums(shared.value)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (block.words, found, gain))], ["doc_id", "n_words", "n_features", "weight"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, score: str, tie: str, eligible: str, percent: int) -> DataFrame:
    """Adds rank: 1, 2, 3... for the highest scores among eligible rows, `percent` hundredths of them; null for others.

    rows: a written table, since it is read twice. Rows are dealt by ranges of (eligible, score, tie) and written with
    their range; a row's rank is its place in its range behind the eligible rows of the ranges before.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc(eligible), F.desc(score), F.asc(tie)]
    dealt = written(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    own = dealt.groupBy("_range").agg(F.count_if(eligible).alias("_n"))
    through = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row a range: as many as partitions.
    before = own.select("_range", F.coalesce(F.sum("_n").over(through), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    drawn = F.col(eligible) & (F.col("_place") <= F.floor(F.col("_all") * percent / 100))
    out = dealt.join(F.broadcast(before), "_range").withColumn("_place", place)
    return out.withColumn("rank", F.when(drawn, F.col("_place")).cast("long")).select(*rows.columns, "rank")


def noise(doc_id: F.Column, seed: int) -> F.Column:
    """Gumbel noise in thousandths from the first 32 bits of a hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.left(F.sha2(text.cast("binary"), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document. target: has text."""
    scored = weights(documents, gains(documents, target)).withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long"))
    scored = written(scored.withColumn("eligible", F.col("n_words") >= least_words), "scores")
    return ranked(scored, "score", "doc_id", "eligible", percent).drop("eligible")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: The same by plain strings: every n-gram apart, its CRC by table over the bytes in hexadecimal digits.
SQL = f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
lists AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
grams AS (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM lists),
counted AS (SELECT side, id, g, count(*) AS n FROM grams GROUP BY ALL),
once AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM counted)),
hashed AS (SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INT), 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % {BUCKETS} AS bucket FROM once, crc),
placed AS (SELECT side, id, bucket, n FROM counted JOIN hashed USING (g)),
sides AS (SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM placed GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM sides),
gained AS (SELECT bucket, floor(1000 * ln((coalesce(a.t, 0) + 1)::DOUBLE * (b.s + {BUCKETS}) / ((coalesce(a.s, 0) + 1)::DOUBLE * (b.t + {BUCKETS})))) AS gain FROM sides a, totals b),
weighed AS (SELECT id, sum(n) AS n, sum(n * gain) AS weight FROM placed JOIN gained USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (SELECT l.id AS doc_id, len(w) >= {LEAST_WORDS} AS takes_part, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || left(sha256('{SEED}:' || l.id), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM lists l LEFT JOIN weighed v ON l.id = v.id WHERE side = 'd'),
placed2 AS (SELECT *, row_number() OVER (PARTITION BY takes_part ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY takes_part) AS many FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN takes_part AND place <= many * {PERCENT} // 100 THEN place END AS rank FROM placed2
"""
