"""Hard-negative mining by a two-dimensional block matrix multiply (SUMMA): anchors by all rows, cut three ways.

Anchors are dealt into blocks i, all rows into blocks j, and the dimensions of both into chunks k. Block (i, k) of the
anchors goes to every j and block (j, k) of the rows to every i; where the blocks of one (i, j) meet, the products of
the chunks are added to int64 scores, some anchors at a time, and reduced at once: to the best rows of the anchor's own
label, whose best over all (i, j) are the anchor's positives. The blocks meet a second time, the anchors with their
positives, for the best other rows inside each positive's window of scores. Scores are neither written nor sent.

A block holds so many rows at most on average, dealt by a hash of the id, whatever the number of rows, of one label or
of one anchor's neighbours. Blocks meet by key in a shuffle and are never broadcast: Spark takes copied blocks for
as small as the blocks that they are copied from.

Defined cases: rows without id, label or vector, or with a component that is null or not finite, take no part; shorter
vectors are padded with zeros; rows repeated in id, label and vector count once; another row is one with another id;
a table without anchors gives no rows. Scores are exact as long as they and 100 times a positive's fit 64 bits. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

#: Anchors and rows of a block on average, and dimensions of a chunk. A score costs dimensions / ANCHORS + dimensions /
#: ROWS numbers sent.
ANCHORS, ROWS, CHUNK = 4096, 4096, 32
#: Anchors whose scores with a block's rows are in memory at a time.
STRIP = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative scores so many hundredths of its positive's score at least, and 100 at most.
LEAST_PERCENT = 80
#: What numbers may be sent as, the least that holds them all.
KINDS = {"short": 2**15, "int": 2**31, "long": 2**63}
#: No score.
NONE = np.iinfo(np.int64).min


def quantized(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and x, whole numbers of 256ths, of the rows that take part; each once."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    good = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), x.alias("x"))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").filter(good)
    return rows.withColumn("x", F.transform("x", lambda v: F.floor(v * 256).cast("long"))).distinct()


def _blocks(rows: DataFrame, number: int, key: str, chunks: int, kind: str) -> DataFrame:
    """Rows dealt into blocks and their vectors into chunks: key, k, and the block's rows (vec_id, label, x, others) by id."""
    dealt = rows.withColumn(key, F.pmod(F.xxhash64("vec_id", F.lit(key)), F.lit(number)).cast("int")).withColumn("whole", F.xxhash64("x"))
    others = [c for c in rows.columns if c not in ("vec_id", "label", "x")]
    cut = dealt.select(key, "vec_id", "label", "whole", *others, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda k: F.slice("x", k * CHUNK + 1, CHUNK).cast(f"array<{kind}>"))).alias("k", "x"))
    # A block has a bounded number of rows, so a list of it is bounded too. Vectors of one id stand alike in all chunks.
    return cut.groupBy(key, "k").agg(F.array_sort(F.collect_list(F.struct("vec_id", "label", "whole", "x", *others))).alias(f"{key}_rows"))


def _matrix(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and the (rows, CHUNK) matrix of one block."""
    vectors = rows.field("x")
    out = np.zeros((len(rows), CHUNK), np.int64)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out[np.arange(CHUNK) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return rows.field("vec_id").to_numpy(zero_copy_only=False), rows.field("label").to_numpy(zero_copy_only=False), out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed in whole numbers: in doubles where every sum stays below 2**53 and so is exact."""
    top = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    if top(a) * top(b) * a.shape[1] < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _by_chunk(blocks: pa.Table, column: str) -> dict[int, pa.StructArray]:
    lists = blocks.column(column).combine_chunks()
    return {k: lists.slice(n, 1).flatten() for n, k in enumerate(blocks.column("k").to_pylist())}


def _sums(anchors: dict[int, pa.StructArray], rows: dict[int, pa.StructArray]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some anchors at a time: where they stand in their block, their ids and labels, the rows' ids and labels, scores."""
    left, right = ({k: _matrix(x) for k, x in sorted(side.items())} for side in (anchors, rows))
    (ids, labels, _), (row_ids, row_labels, _) = left[0], right[0]
    for s in (slice(at, at + STRIP) for at in range(0, len(ids), STRIP)):
        yield s, ids[s], labels[s], row_ids, row_labels, sum(product(left[k][2][s], right[k][2]) for k in left)


def _best(scores: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the best allowed scores of each row, so many at most; of equal ones the first columns."""
    counts = np.minimum(allowed.sum(axis=1), most)
    some = np.flatnonzero(counts)
    counts, rest, at = counts[some], np.where(allowed[some], scores[some], NONE), np.arange(len(some))
    found = np.zeros((len(some), int(counts.max(initial=0))), np.int64)
    for n in range(found.shape[1]):
        found[:, n] = rest.argmax(axis=1)
        rest[at, found[:, n]] = NONE
    good = np.arange(found.shape[1]) < counts[:, None]
    return some[np.nonzero(good)[0]], found[good]


def meeting(rows: DataFrame, anchors: DataFrame, reduce: Callable, schema: str) -> DataFrame:
    """What `reduce` makes of every block of anchors and block of rows: it gets the chunks of both, and yields columns.

    Both tables: vec_id, label, x; others of anchors come along.
    """
    n, size, low, high = rows.agg(F.count("*"), F.max(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    kind = next(k for k, most in KINDS.items() if -most <= (low or 0) and (high or 0) < most)
    across, down, chunks = max(1, -(-n // ROWS)), max(1, -(-anchors.count() // ANCHORS)), max(1, -(-(size or 1) // CHUNK))
    # Few blocks of anchors, copied many times: each by a task of its own.
    left = _blocks(anchors, down, "i", chunks, kind).repartition(down * chunks).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    right = _blocks(rows, across, "j", chunks, kind).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        parts = list(reduce(_by_chunk(a, "i_rows"), _by_chunk(b, "j_rows"))) if a.num_rows and b.num_rows else []
        columns = zip(*parts, strict=True) if parts else [[np.zeros(0, np.int64)]] * len(names)
        return pa.Table.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in columns], names)

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, schema)


def positives(rows: DataFrame, anchors: DataFrame, most: int = POSITIVES) -> DataFrame:
    """anchor_id, positive_id, positive_score: the best other rows of each anchor's label."""

    def reduce(a, b):
        for _, ids, labels, others, other_labels, scores in _sums(a, b):
            # Rows stand by id, so the first of equal scores is that of the least id.
            r, c = _best(scores, (other_labels == labels[:, None]) & (others != ids[:, None]), most)
            yield ids[r], others[c], scores[r, c]

    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = meeting(rows, anchors, reduce, "anchor_id long, positive_id long, positive_score long")
    return found.withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= most).drop("_place")


def negatives(rows: DataFrame, anchors: DataFrame, wanted: DataFrame, most: int = NEGATIVES, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. wanted: as `positives` gives it."""
    # An anchor has some positives at most.
    lists = wanted.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("wanted"))
    asking = anchors.join(lists, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")

    def reduce(a, b):
        lists = a[0].field("wanted")
        sizes, pairs = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten()
        starts = np.cumsum(sizes) - sizes
        positive, positive_score = (pairs.field(c).to_numpy(zero_copy_only=False) for c in ("positive_id", "positive_score"))
        for s, ids, labels, others, other_labels, scores in _sums(a, b):
            other = other_labels != labels[:, None]
            for p in range(sizes[s].max(initial=0)):
                # Anchors with fewer positives look at another's, and find nothing.
                at = np.minimum(starts[s] + p, len(positive) - 1)
                limit = positive_score[at]
                least = np.where(sizes[s] > p, -(-least_percent * limit // 100), np.iinfo(np.int64).max)
                r, c = _best(scores, other & (scores <= limit[:, None]) & (scores >= least[:, None]), most)
                yield ids[r], positive[at[r]], limit[r], others[c], scores[r, c]

    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = meeting(rows, asking, reduce, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(rows: DataFrame, is_anchor: F.Column) -> DataFrame:
    """Hard negatives of every anchor and positive. rows: vec_id, label, x (whole numbers)."""
    rows = written(rows, "vectors")
    anchors = rows.filter(is_anchor)
    return negatives(rows, anchors, written(positives(rows, anchors), "positives"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantized(table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


SQL = f"""
WITH good AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda v: CAST(floor(256 * v::DOUBLE) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike,
  CAST(list_sum(list_transform(range(1, least(len(a.x), len(b.x)) + 1), lambda i: a.x[i] * b.x[i])) AS BIGINT) AS score FROM good a JOIN good b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place FROM scored WHERE alike) WHERE place <= {POSITIVES}),
pairs AS (SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS place
  FROM positive p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.alike AND {LEAST_PERCENT} * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, CAST(place AS INT) AS rank, negative_id, positive_score, negative_score FROM pairs WHERE place <= {NEGATIVES}
"""
