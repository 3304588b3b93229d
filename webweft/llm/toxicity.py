"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a word: a learned word vector, the class log odds in the training sample of the word and of its likeliest
prefix and suffix (hashed; affixes count where a document has them twice), and the mean of learned vectors of its character n-grams. Two gated recurrent units read every window of WINDOW words, one forwards and one
backwards; attention weighs their states. All overlapping windows of the whole text are scored (a new one every
STRIDE words) and the worst window decides. Training labels are of documents, so a toxic document is learnt from the
window that the network finds worst, chosen anew after every round.

Defined cases: null and empty texts are one window without words; repeated rows get equal scores; a training sample
without both classes gives score 0 (or 1). Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, slices, small_batches, table, texts_of, training_texts
from .langid import word_features
from .textvec import Words, mix

WINDOW, STRIDE = 32, 8
WORD_BITS, CHAR_BITS, ODDS_BITS = 15, 13, 17
WORD_DIM, CHAR_DIM, HIDDEN = 8, 6, 8
#: Bound of the training sample: so many labelled rows of each class.
TRAIN_ROWS_PER_CLASS = 700
#: Words in fewer training documents get no learned vector of their own, only their odds and characters.
KNOWN_FROM = 5


def windows(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all windows (-1: no word), and the text that each window is of."""
    count = np.diff(words.ptr)
    per = 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE))
    owner = np.repeat(np.arange(len(count)), per)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    at = (words.ptr[:-1][owner] + nth * STRIDE)[:, None] + np.arange(WINDOW)
    again = np.zeros(len(words.hashes) + 1, bool)  # a word that stutters counts once
    again[1:-1] = words.hashes[1:] == words.hashes[:-1]
    inside = at < words.ptr[1:][owner][:, None]
    return np.where(inside & ~again[np.where(inside, at, 0)], at, -1), owner


def affixes(words: Words, of: np.ndarray) -> np.ndarray:
    """(len(of), 3, 5) buckets: the word itself, its prefixes and its suffixes of 4 to 8 bytes; bucket 0 is none."""
    start, size = words.starts[of], words.ends[of] - words.starts[of]
    at, data = np.arange(8), np.concatenate([words.data, np.zeros(8, np.uint8)])
    head = data[start[:, None] + at].astype(np.uint64)
    back = data[np.maximum(words.ends[of][:, None] - 1 - at, 0)].astype(np.uint64)
    out = np.zeros((len(of), 3, 5), np.int32)
    out[:, 0, 0] = words.hashes[of] >> np.uint64(64 - ODDS_BITS)
    for kind, side in ((1, head), (2, back)):
        h = np.full(len(of), kind, np.uint64)
        for k in range(8):
            h = mix(h * np.uint64(257) + side[:, k])
            if k >= 3:
                out[:, kind, k - 3] = np.where(size > k, h >> np.uint64(64 - ODDS_BITS), 0)
    return out


def chars_of(words: Words, of: np.ndarray) -> np.ndarray:
    """Buckets of the character n-grams of the words numbered `of`; 0 is none."""
    parts = [(word_features(words, of[a : a + 10_000]) & ((1 << CHAR_BITS) - 1)).astype(np.uint16) for a in range(0, len(of), 10_000)]
    return np.concatenate(parts) if parts else np.zeros((0, 1), np.uint16)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class ToxicityModel:
    p: dict[str, np.ndarray] = field(default_factory=dict)
    odds: np.ndarray = field(default_factory=lambda: np.zeros(1 << ODDS_BITS, np.float32))
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def inputs(self, hashes: np.ndarray, chars: np.ndarray, odds: np.ndarray) -> np.ndarray:
        """Input vectors of distinct words; the last row is of no word. odds: (words, 3)."""
        x = np.zeros((len(hashes) + 1, WORD_DIM + 3 + CHAR_DIM), np.float32)
        for a in range(0, len(hashes), 10_000):
            some = slice(a, min(a + 10_000, len(hashes)))
            x[some, :WORD_DIM] = self.p["words"][(hashes[some] >> np.uint64(64 - WORD_BITS)).astype(np.int64)]
            x[some, WORD_DIM : WORD_DIM + 3] = odds[some]
            have = (chars[some] > 0).sum(1, keepdims=True)
            x[some, WORD_DIM + 3 :] = self.p["chars"][chars[some]].sum(1) / np.maximum(have, 1)
        return x

    def forward(self, x: np.ndarray, idx: np.ndarray, keep: bool = False):
        """Logits of windows; x: inputs of distinct words, idx: (windows, WINDOW) rows of x, the last: none."""
        p, n, steps = self.p, len(idx), idx.shape[1]
        gates = [x @ p["in"][d] + p["bias"][d] for d in (0, 1)]
        states, tape = np.zeros((steps, n, 2 * HIDDEN), np.float32), []
        for d in (0, 1):
            h = np.zeros((n, HIDDEN), np.float32)
            for s in range(steps) if d == 0 else range(steps - 1, -1, -1):
                a, u = gates[d][idx[:, s]], h @ p["rec"][d]
                zr = _sigmoid(a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(a[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
                if keep:
                    tape.append((d, s, h, z, r, c, u[:, 2 * HIDDEN :]))
                h = c + z * (h - c)
                states[s, :, d * HIDDEN : (d + 1) * HIDDEN] = h
        real = (idx < len(x) - 1).T
        e = np.where(real, states @ p["attend"], -30)
        a = np.exp(e - e.max(0))
        a *= real
        a /= np.maximum(a.sum(0), 1e-9)
        pooled = (a[:, :, None] * states).sum(0)
        logit = pooled @ p["out"] + p["out_bias"][0]
        return (logit, states, a, pooled, tape) if keep else logit

    def logits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The logit of every window, and the text that it is of."""
        _, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        x = self.inputs(words.hashes[first], chars_of(words, first), self.odds[affixes(words, first)].max(2))
        at, owner = windows(words)
        return self.all_logits(x, np.where(at >= 0, np.append(back, 0)[at], len(x) - 1)), owner

    def all_logits(self, x: np.ndarray, idx: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.float32), *(self.forward(x, idx[i : i + 2048]) for i in range(0, len(idx), 2048))])

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None or not len(texts):
            return np.full(len(texts), self.constant or 0.0)
        logit, owner = self.logits(Words(pc.utf8_lower(texts), plain=True).pieces())
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, owner, logit)
        return _sigmoid(np.clip(self.slope * worst + self.shift, -40, 40))


def _backward(model: ToxicityModel, x: np.ndarray, idx: np.ndarray, y: np.ndarray):
    """Loss gradients of the parameters, and of the inputs of distinct words."""
    p = model.p
    logit, states, a, pooled, tape = model.forward(x, idx, keep=True)
    dl = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
    g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("words", "chars")}
    g["out"], g["out_bias"] = pooled.T @ dl, np.array([dl.sum()], np.float32)
    dp = dl[:, None] * p["out"]
    da = (states * dp).sum(2)
    ds = a * (da - (a * da).sum(0))
    g["attend"] = (ds[:, :, None] * states).sum((0, 1))
    dstates = a[:, :, None] * dp + ds[:, :, None] * p["attend"]
    dx = np.zeros_like(x)
    carry = [np.zeros((len(y), HIDDEN), np.float32) for _ in (0, 1)]
    for d, s, before, z, r, c, uc in reversed(tape):
        dh = dstates[s, :, d * HIDDEN : (d + 1) * HIDDEN] + carry[d]
        dac = dh * (1 - z) * (1 - c * c)
        daz = dh * (before - c) * z * (1 - z)
        dar = dac * uc * r * (1 - r)
        du = np.concatenate([daz, dar, dac * r], 1)
        dgate = np.concatenate([daz, dar, dac], 1)
        carry[d] = dh * z + du @ p["rec"][d].T
        g["rec"][d] += before.T @ du
        g["in"][d] += x[idx[:, s]].T @ dgate
        g["bias"][d] += dgate.sum(0)
        np.add.at(dx, idx[:, s], dgate @ p["in"][d].T)
    return g, dx


def _odds(df0: np.ndarray, df1: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Class log odds of documents with a word, shrunk where few have it."""
    odds = np.log((df1 + 0.5) / ((y == 1).sum() + 1)) - np.log((df0 + 0.5) / ((y == 0).sum() + 1))
    odds = odds * (df0 + df1) / (df0 + df1 + 6.0)
    odds = (np.sign(odds) * np.maximum(np.abs(odds) - 0.8, 0)).astype(np.float32)
    odds[0] = -1.0  # no such affix
    return odds


def fit(sample: list[tuple[str, int]], rounds: int = 8, steps: int = 75, batch: int = 64, seed: int = 3) -> ToxicityModel:
    y = np.array([c for _, c in sample], int)
    if len(set(y.tolist())) < 2:
        return ToxicityModel(constant=float(y[0]) if len(y) else 0.0)
    draw = np.random.default_rng(seed)
    words = Words(pc.utf8_lower(pa.array([t for t, _ in sample], pa.large_string())), plain=True).pieces()
    _, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
    chars, hashes = chars_of(words, first), words.hashes[first]
    bucket = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    parts = affixes(words, first)
    doc = np.repeat(np.arange(len(y)), np.diff(words.ptr))
    # A document counts for a word that it has, and for an affix that it has twice.
    pairs, times = np.unique(doc * np.int64(max(len(hashes), 1)) + back, return_counts=True)
    own, word = pairs // max(len(hashes), 1), pairs % max(len(hashes), 1)
    cells, cell = np.unique(own[:, None] << ODDS_BITS | parts[word, 1:].reshape(-1, 10), return_inverse=True)
    twice = cells[np.bincount(cell.ravel(), weights=np.repeat(times, 10), minlength=len(cells)) >= 2]
    seen = np.concatenate([np.unique(own << ODDS_BITS | parts[word, 0, 0]), twice])
    cls, at = y[seen >> ODDS_BITS], seen & ((1 << ODDS_BITS) - 1)
    df = [np.bincount(at[cls == c], minlength=1 << ODDS_BITS) for c in (0, 1)]
    odds = _odds(df[0], df[1], y)
    # In training a document's own count is left out, so that what is seen in it alone tells nothing.
    without = np.concatenate([_odds(np.maximum(df[0] - 1, 0), df[1], y)[parts].max(2), _odds(df[0], np.maximum(df[1] - 1, 0), y)[parts].max(2)])
    known = (df[0] + df[1])[parts[:, 0, 0]] >= KNOWN_FROM
    size = WORD_DIM + 3 + CHAR_DIM
    init = lambda *s, scale=0.1: (draw.standard_normal(s) * scale).astype(np.float32)
    model = ToxicityModel({"words": init(1 << WORD_BITS, WORD_DIM, scale=0.0), "chars": init(1 << CHAR_BITS, CHAR_DIM), "in": init(2, size, 3 * HIDDEN, scale=0.3), "rec": init(2, HIDDEN, 3 * HIDDEN, scale=0.3), "bias": np.zeros((2, 3 * HIDDEN), np.float32), "attend": init(2 * HIDDEN, scale=0.3), "out": init(2 * HIDDEN, scale=0.3), "out_bias": np.zeros(1, np.float32)}, odds)
    at, owner = windows(words)
    idx = np.where(at >= 0, np.append(back, 0)[at], len(hashes))
    many = len(hashes)
    strength = np.sort(np.append(without.max(1).reshape(2, -1), [[-1], [-1]], 1)[y[owner][:, None], idx], 1)[:, -2:].sum(1)
    good, bad = np.flatnonzero(y[owner] == 0), np.flatnonzero(y == 1)
    m1, m2, t = {k: np.zeros_like(v) for k, v in model.p.items()}, {k: np.zeros_like(v) for k, v in model.p.items()}, 0
    for _ in range(rounds):
        order = np.lexsort((strength, owner))
        worst = order[np.append(owner[order][1:] != owner[order][:-1], True)]  # the last of each text
        hard = good[np.argsort(-strength[good])[: max(batch, len(good) // 50)]]
        for _ in range(steps):
            pos = worst[bad[draw.integers(len(bad), size=batch // 2)]]
            neg = np.concatenate([good[draw.integers(len(good), size=batch // 4)], hard[draw.integers(len(hard), size=batch // 4)]])
            pick = np.concatenate([pos, neg])
            keyed = np.where(idx[pick] < many, idx[pick] + many * y[owner[pick]][:, None], 2 * many)
            keys, rows = np.unique(keyed, return_inverse=True)
            keys = keys[keys < 2 * many]
            rows, own = rows.reshape(len(pick), WINDOW), keys % many
            x = model.inputs(hashes[own], chars[own], without[keys])
            g, dx = _backward(model, x, rows, np.repeat([1.0, 0.0], [len(pos), len(neg)]))
            g["words"], g["chars"] = np.zeros_like(model.p["words"]), np.zeros_like(model.p["chars"])
            dx = dx[: len(own)]
            np.add.at(g["words"], bucket[own], dx[:, :WORD_DIM] * known[own][:, None])
            have = np.maximum((chars[own] > 0).sum(1, keepdims=True), 1)
            np.add.at(g["chars"], chars[own].ravel(), np.repeat(dx[:, WORD_DIM + 3 :] / have, chars.shape[1], 0))
            g["chars"][0] = 0
            t += 1
            for k, v in model.p.items():
                if k in ("words", "chars"):
                    v *= 0.995
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.99 * m2[k] + 0.01 * g[k] ** 2
                v -= ((0.002 if k in ("words", "chars") else 0.02) * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        strength = model.all_logits(model.inputs(hashes, chars, odds[parts].max(2)), idx)
    top = np.full(len(y), -np.inf)
    np.maximum.at(top, owner, strength)
    # Score 0.6 halfway between the edges of the classes; some labels are taken to be wrong.
    low, high = np.quantile(top[y == 0], 0.995), np.quantile(top[y == 1], 0.12)
    model.slope = float(4 / max(abs(high - low), 1.0))
    model.shift = float(0.4 - model.slope * (low + high) / 2)
    return model


def train(documents: DataFrame, labels: DataFrame, training_rows: Column, per_class: int = TRAIN_ROWS_PER_CLASS) -> ToxicityModel:
    return fit(training_texts(documents, labels, "toxic", training_rows, per_class))


def score(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # fixed table sizes, about 2 MB

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=1 << 19):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.scores(texts_of(part)), pa.float64())], ["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def held_out() -> Column:
    return F.pmod(crc_of_id(F.col("doc_id")), F.lit(3)) == 1


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels"), ~held_out())
    return score(documents, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
