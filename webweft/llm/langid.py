"""Language ID: a linear-chain conditional random field over the words of code-switched text.

Every word has affix, n-gram and lexicon features (hashed, over its UTF-8 bytes without case); their weights give
the word's emission for each language, and learned transitions join neighbours. Words of more than 16 bytes, and so
texts without spaces, are read as a sequence of overlapping pieces of 16 bytes: no byte is left out. Forward-backward gives each word's
language probabilities; a document's language is the one with the largest mean probability, its score that mean.

Long documents are cut into segments whose transfer matrices are multiplied, so that the result is the exact
forward-backward over the whole text while numpy works on all segments of a batch at once. With more languages than
WIDE_FROM such matrices would be larger than what they are made from; then the words are walked one after the other, all
documents of a batch at once. The more languages, the smaller the batches; the model has 2**BITS weights for each.

Every language that has a word in the sample is learned: sequences of languages with few words repeat them.

Defined cases: a null text or one without a letter is `und` with score 0; repeated rows get equal results; without any
training text every document is `und`; an empty table gives an empty result. Columns other than doc_id, text and (for
training) lang are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, crc_of_id, slices, small_batches, table, texts_of
from .textvec import Words, mix

BITS = 16
#: Bound of the training sample: so many documents of each language.
TRAIN_DOCS_PER_LANGUAGE = 250
#: Bound of the training sample over all languages, but for FEWEST documents that each language has at least.
TRAIN_DOCS, FEWEST = 5000, 4
#: Languages from which on no transfer matrices are made.
WIDE_FROM = 24
#: Words of a training sequence and of a segment.
SEGMENT = 64
LETTER = re.compile(r"[^\W\d_]")
_WIDE = 16


def word_features(words: Words, of: np.ndarray) -> np.ndarray:
    """(len(of), k) hashed feature buckets of the words numbered `of`; bucket 0 is none.

    Features: the word itself (lexicon), affixes of 1 to 4 bytes, and all byte pairs and triples. words: pieces, of 16
    bytes at most.
    """
    start, size = words.starts[of], words.ends[of] - words.starts[of]
    at = np.arange(_WIDE)
    data = np.concatenate([words.data, np.zeros(_WIDE, np.uint8)])
    head = np.where(at < size[:, None], data[start[:, None] + at], 0).astype(np.uint64)
    back = np.where(at < np.minimum(size, 4)[:, None], data[np.maximum(words.ends[of][:, None] - 1 - at, 0)], 0).astype(np.uint64)
    out = [words.hashes[of][:, None] ^ np.uint64(0x51)]
    for n in (1, 2, 3, 4):
        for kind, side in ((1, head), (2, back)):
            h = np.full(len(of), kind * 16 + n, np.uint64)
            for k in range(n):
                h = h << np.uint64(8) | side[:, k]
            out.append(np.where(size >= n, mix(h), 0)[:, None])
    for n in (2, 3):
        h = np.full((len(of), _WIDE - n + 1), 3 * 16 + n, np.uint64)
        for k in range(n):
            h = h << np.uint64(8) | head[:, k : _WIDE - n + 1 + k]
        out.append(np.where(np.arange(_WIDE - n + 1) + n <= size[:, None], mix(h), 0))
    h = np.concatenate(out, 1)
    return np.where(h > 0, (h >> np.uint64(64 - BITS)).astype(np.int64) | 1, 0)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # (2**BITS, languages)
    transitions: np.ndarray  # (languages, languages), log

    def emissions(self, words: Words) -> np.ndarray:
        """Log emission of every word; each distinct word of the batch is worked out once."""
        _, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        table = np.concatenate([self.weights[word_features(words, first[i : i + 20000])].sum(1) for i in range(0, len(first), 20000)] or [np.zeros((0, len(self.languages)))])
        return table[back]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not self.languages:
            return ["und"] * n, np.zeros(n)
        words = Words(pc.utf8_lower(texts)).pieces(_WIDE)
        total = marginal_sums(self.emissions(words), words.ptr, self.transitions)
        count = np.maximum(np.diff(words.ptr), 1)
        mean = total / count[:, None]
        best = mean.argmax(1)
        letters = [bool(LETTER.search(t)) for t in texts.to_pylist()]
        return [self.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, np.clip(mean.max(1), 0, 1), 0.0)


def marginal_sums(emission: np.ndarray, ptr: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Sum over each sequence's words of the label probabilities, by forward-backward over the whole sequence."""
    k, lengths = transitions.shape[0], np.diff(ptr)
    if k >= WIDE_FROM:
        return _walked_sums(emission, ptr, transitions)
    out = np.zeros((len(lengths), k))
    segments = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(len(lengths)), segments)
    if not len(owner):
        return out
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(segments) - segments, segments)
    begin = ptr[:-1][owner] + nth * SEGMENT
    size = np.minimum(SEGMENT, ptr[1:][owner] - begin)
    at = begin[:, None] + np.arange(SEGMENT)
    real = np.arange(SEGMENT) < size[:, None]
    e = emission[np.minimum(at, len(emission) - 1)]
    e = np.exp(e - e.max(2, keepdims=True))
    e[~real] = 1.0
    t = np.exp(transitions - transitions.max())
    # Transfer matrices: row = label before the segment (after its transition), column = label of the last word.
    move = np.broadcast_to(np.eye(k), (len(owner), k, k)).copy()
    for s in range(SEGMENT):
        step = (move @ t) * e[:, s][:, None, :]
        step /= step.sum((1, 2), keepdims=True)
        move = np.where(real[:, s, None, None], step, move)
    # Boundary messages, a loop over the segments of the longest document.
    enter, leave = np.full((len(owner), k), 1.0 / k), np.full((len(owner), k), 1.0 / k)
    for r in range(1, int(segments.max())):
        now = np.flatnonzero(nth == r)
        m = (enter[now - 1][:, None, :] @ move[now - 1])[:, 0]
        enter[now] = m / m.sum(1, keepdims=True)
    last = segments[owner] - 1 - nth
    for r in range(1, int(segments.max())):
        now = np.flatnonzero(last == r)
        m = (move[now + 1] @ leave[now + 1][:, :, None])[:, :, 0]
        leave[now] = m / m.sum(1, keepdims=True)
    forward = np.empty((SEGMENT, len(owner), k))
    a = enter
    for s in range(SEGMENT):
        step = (a @ t) * e[:, s]
        step /= step.sum(1, keepdims=True)
        a = forward[s] = np.where(real[:, s, None], step, a)
    b, summed = leave, np.zeros((len(owner), k))
    for s in range(SEGMENT - 1, -1, -1):
        p = forward[s] * b
        summed += np.where(real[:, s, None], p / p.sum(1, keepdims=True), 0)
        step = (b * e[:, s]) @ t.T
        b = np.where(real[:, s, None], step / step.sum(1, keepdims=True), b)
    np.add.at(out, owner, summed)
    return out


def _walked_sums(emission: np.ndarray, ptr: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The same word by word, longest sequence first, so that those still running are the first rows."""
    k, lengths = transitions.shape[0], np.diff(ptr)
    order = np.argsort(-lengths, kind="stable")
    begin, size = ptr[:-1][order], lengths[order]
    running = [int(np.searchsorted(-size, -s)) for s in range(int(size.max(initial=0)) + 1)]  # longer than s
    t = np.exp(transitions - transitions.max())
    x = lambda at: np.exp(emission[at] - emission[at].max(1, keepdims=True))
    forward = np.zeros_like(emission)
    a = np.full((len(size), k), 1.0 / k)
    for s in range(len(running) - 1):
        at = begin[: running[s]] + s
        step = (a[: running[s]] @ t) * x(at)
        a[: running[s]] = forward[at] = step / step.sum(1, keepdims=True)
    out, b = np.zeros((len(size), k)), np.full((len(size), k), 1.0 / k)
    for s in range(len(running) - 2, -1, -1):
        at = begin[: running[s]] + s
        p = forward[at] * b[: running[s]]
        out[order[: running[s]]] += p / p.sum(1, keepdims=True)
        step = (b[: running[s]] * x(at)) @ t.T
        b[: running[s]] = step / step.sum(1, keepdims=True)
    return out


def _gradient(e: np.ndarray, y: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the log likelihood of full sequences (batch, length, labels) for emissions and transitions."""
    n, size, k = e.shape
    t, x = np.exp(trans - trans.max()), np.exp(e - e.max(2, keepdims=True))
    f, b = np.empty((size, n, k)), np.empty((size, n, k))
    f[0] = x[:, 0] / x[:, 0].sum(1, keepdims=True)
    for s in range(1, size):
        a = (f[s - 1] @ t) * x[:, s]
        f[s] = a / a.sum(1, keepdims=True)
    b[-1] = 1.0
    pair = np.zeros((k, k))
    for s in range(size - 2, -1, -1):
        right = x[:, s + 1] * b[s + 1]
        a = right @ t.T
        # The probabilities of neighbouring labels, summed over the batch.
        pair += t * ((f[s] / (f[s] * a).sum(1, keepdims=True)).T @ right)
        b[s] = a / a.sum(1, keepdims=True)
    p = f * b
    p /= p.sum(2, keepdims=True)
    hot = np.eye(k)[y]
    seen = np.zeros((k, k))
    np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    return hot - p.transpose(1, 0, 2), seen - pair


def fit(sample: list[tuple[str, str]], steps: int = 150, batch: int = 64, seed: int = 5) -> LanguageModel:
    """Adagrad on the likelihood of word labels; half of the sequences are spliced from two languages (code-switched)."""
    words = Words(pc.utf8_lower(pa.array([t for t, _ in sample], pa.large_string()))).pieces(_WIDE)
    many = np.diff(words.ptr)
    languages = sorted({lang for (_, lang), n in zip(sample, many, strict=True) if n})
    k = len(languages)
    weights, trans = np.zeros((1 << BITS, k)), np.zeros((k, k))
    if k == 0:
        return LanguageModel([], weights, trans)
    draw = np.random.default_rng(seed)
    number = {lang: c for c, lang in enumerate(languages)}
    label = np.repeat(np.array([number.get(lang, 0) for _, lang in sample], np.int64), many)
    _, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
    feats = word_features(words, first) if len(first) else np.zeros((0, 1), int)
    size = 24
    by_lang = [np.flatnonzero(label == c) for c in range(k)]
    by_lang = [x if len(x) >= size else np.resize(x, size) for x in by_lang]
    g_w, g_t = np.full_like(weights, 1e-6), np.full_like(trans, 1e-6)
    for _ in range(steps):
        rows = []
        for i in range(batch):
            one = by_lang[draw.integers(len(by_lang))]
            at = draw.integers(len(one) - size + 1)
            row = one[at : at + size].copy()
            if i % 2:
                other, cut = by_lang[draw.integers(len(by_lang))], draw.integers(1, size)
                at = draw.integers(len(other) - size + 1)
                row[cut:] = other[at + cut : at + size]
            rows.append(row)
        idx = np.array(rows)
        f = feats[back[idx]]
        de, dt = _gradient(weights[f].sum(2), label[idx], trans)
        # Only the weights of the batch's features move.
        rows, at = np.unique(f, return_inverse=True)
        grad = np.stack([np.bincount(at.ravel(), np.repeat(de[:, :, c].ravel(), f.shape[2]), len(rows)) for c in range(k)], 1)
        grad = grad / batch - 1e-4 * weights[rows]
        grad[rows == 0] = 0
        dt = dt / batch - 1e-3 * trans
        g_w[rows] += grad**2
        g_t += dt**2
        weights[rows] += 0.2 * grad / np.sqrt(g_w[rows])
        trans += 0.1 * dt / np.sqrt(g_t)
    weights[0] = 0
    return LanguageModel(languages, weights.astype(np.float32), trans)


def train(documents: DataFrame, training_rows: Column, per_language: int = TRAIN_DOCS_PER_LANGUAGE) -> LanguageModel:
    """Fit on about per_language rows of each language, fewer if there are many; of rows of one doc_id and language the
    least text counts."""
    known = documents.filter(training_rows & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    languages = known.agg(F.count_distinct("lang")).first()[0]
    per_language = max(FEWEST, min(per_language, TRAIN_DOCS // max(1, languages)))
    chosen = F.broadcast(bounded_sample(known, "lang", per_language).distinct())
    texts = documents.filter(F.col("text").isNotNull()).select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"])
    rows = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    return fit([(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["lang"]))])


def predict(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights for each language
    most = (1 << 19) * 16 // max(16, len(model.languages))

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=most):
                lang, value = shared.value.predict(texts_of(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(value, pa.float64())], ["doc_id", "lang_pred", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    return F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) == 2


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    documents = table(spark, sf_dir, "documents")
    return predict(documents, train(documents, ~held_out())).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
