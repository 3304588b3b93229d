"""Quality classifier: naive Bayes support vectors.

Every text becomes n-gram indicators, hashed into 2**BITS buckets: byte trigrams, words, word pairs, and n-grams of
"this word repeats the one before" (which see stuttering text in any language). Each indicator is scaled by its class log-count ratio, and a linear hinge-loss model is fit on the scaled, length-normed
vectors by dual coordinate descent. A logistic curve fit on out-of-fold margins turns margins into scores.

Defined cases: null and empty texts have no indicators and get the score of the bias alone; repeated rows get equal
scores; long texts are scored whole; a training sample without both classes gives the constant share of label 1.
Columns of the input other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, slices, small_batches, table, texts_of, training_texts
from .textvec import Words, mix

BITS = 18
#: Bound of the training sample: so many labelled rows of each class.
TRAIN_ROWS_PER_CLASS = 3000


def indicators(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted buckets of the n-grams that it has."""
    words = Words(texts)
    shift = np.uint64(64 - BITS)
    uni = (words.hashes >> shift).astype(np.int64)
    pairs, pair_ptr = words.grams(2)
    pairs = (pairs >> shift).astype(np.int64)
    d = words.data.astype(np.uint64)
    tri = (mix((d[:-2] | d[1:-1] << np.uint64(8) | d[2:] << np.uint64(16)) + np.uint64(1)) >> shift).astype(np.int64) if len(d) > 2 else np.zeros(0, np.int64)
    same = np.zeros(len(words.hashes), np.uint64)
    same[1:] = words.hashes[1:] == words.hashes[:-1]
    same[words.ptr[:-1][words.ptr[:-1] < len(same)]] = 0
    history = np.ones(len(same), np.uint64)
    repeats = []
    for k in range(8):
        history = history << np.uint64(1)
        history[k:] |= same[: max(len(same) - k, 0)]
        repeats.append(np.where(history > 1 << k + 1, mix(history ^ np.uint64(0xA5A5 << 16)) >> shift, 0).astype(np.int64))
    rate = np.add.reduceat(np.append(same, 0), words.ptr[:-1]) * (np.diff(words.ptr) > 0) / np.maximum(np.diff(words.ptr), 1)
    flags = np.zeros(1 << BITS, bool)
    for i in range(len(texts)):
        flags[uni[words.ptr[i] : words.ptr[i + 1]]] = True
        flags[pairs[pair_ptr[i] : pair_ptr[i + 1]]] = True
        flags[tri[words.offsets[i] : max(words.offsets[i], words.offsets[i + 1] - 2)]] = True
        for x in repeats:
            flags[x[words.ptr[i] : words.ptr[i + 1]]] = True
        for level in range(1, 1 + int(rate[i] * 16)):
            flags[level] = True  # a sixteenth more of its words repeat the one before
        flags[0] = False
        found = np.flatnonzero(flags)
        flags[found] = False
        yield found


@dataclass
class QualityModel:
    weight: np.ndarray  # log-count ratio times the linear model's weight
    square: np.ndarray  # squared log-count ratio, for the norm
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        norm = float(np.sqrt(self.square[found].sum(dtype=np.float64))) or 1.0
        return float(self.weight[found].sum(dtype=np.float64)) / norm + self.bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        m = np.array([self.margin(x) for x in indicators(texts)])
        return 1 / (1 + np.exp(-np.clip(self.slope * m + self.shift, -40, 40)))


def _log_ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    count = {c: np.full(1 << BITS, smooth) for c in (0, 1)}
    for x, c in zip(rows, y, strict=True):
        count[int(c)][x] += 1
    share = {c: v / ((y == c).sum() + 2 * smooth) for c, v in count.items()}
    return np.log(share[1] / share[0]).astype(np.float32)


def _dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """min |w|^2/2 + sum of cost_i * max(0, 1 - y_i w.x_i), one dual variable at a time; classes weigh the same."""
    sign = np.where(y == 1, 1.0, -1.0)
    most = np.where(y == 1, len(y) / (2 * max((y == 1).sum(), 1)), len(y) / (2 * max((y == 0).sum(), 1))) * cost
    norm = [float(np.sqrt((ratio[x].astype(np.float64) ** 2).sum())) or 1.0 for x in rows]
    w, bias, alpha, order = np.zeros(1 << BITS), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    values = [ratio[x].astype(np.float64) / n for x, n in zip(rows, norm, strict=True)]
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            x, v = rows[i], values[i]
            slack = sign[i] * (float(w[x] @ v) + bias) - 1
            new = min(max(alpha[i] - slack / 2.0, 0.0), most[i])  # |x|^2 is 1, and 1 for the bias
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[x] += step * v
                bias += step
                moved, alpha[i] = max(moved, abs(step)), new
        if moved < 1e-3:
            break
    return w, bias


def fit(sample: list[tuple[str, int]], cost: float = 1.0, epochs: int = 12, seed: int = 7) -> QualityModel:
    y = np.array([c for _, c in sample], int)
    zero = np.zeros(1 << BITS, np.float32)
    if len(set(y.tolist())) < 2:
        share = min(max(float(y.mean()), 0.01), 0.99) if len(y) else 0.5
        return QualityModel(zero, zero, 0.0, 1.0, float(np.log(share / (1 - share))))
    rows = [x.astype(np.int32) for at in range(0, len(sample), 200) for x in indicators(pa.array([t for t, _ in sample[at : at + 200]], pa.large_string()))]
    fold = np.random.default_rng(seed).permutation(len(y)) % 3
    margins = np.zeros(len(y))
    for k in (*range(3), -1):
        use = np.flatnonzero(fold != k)
        if len(set(y[use].tolist())) < 2:
            continue
        part = [rows[i] for i in use]
        ratio = _log_ratio(part, y[use])
        w, bias = _dual_descent(part, y[use], ratio, cost, epochs, seed)
        model = QualityModel((w * ratio).astype(np.float32), ratio**2, bias, 1.0, 0.0)
        for i in np.flatnonzero(fold == k):
            margins[i] = model.margin(rows[i])
    slope, shift = _logistic(margins, y)
    return QualityModel(model.weight, model.square, model.bias, slope, shift)


def _logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's method, with softened targets and a small penalty."""
    target = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
    x, beta = np.stack([margins, np.ones(len(y))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def train(documents: DataFrame, labels: DataFrame, training_rows: Column, per_class: int = TRAIN_ROWS_PER_CLASS) -> QualityModel:
    return fit(training_texts(documents, labels, "quality", training_rows, per_class))


def score(documents: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # two arrays of 2**BITS floats, whatever the input

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.scores(texts_of(part)), pa.float64())], ["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def held_out() -> Column:
    return F.pmod(crc_of_id(F.col("doc_id")), F.lit(5)) == 0


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels"), ~held_out())
    return score(documents, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.3) -> DataFrame:
    """Pipeline stage: documents scored at least `least`, with all their columns."""
    small_batches(spark)
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out())
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(shared.value.scores(texts_of(part)) >= least))

    return docs.mapInArrow(run, docs.schema)
