"""Token counts by a map-side two-tier lookup.

A compact table of the lengths of frequent pre-tokens is broadcast; what it lacks is encoded by the tokenizer library
once and kept in a bounded cache of the worker. No pre-token is ever shuffled: the frequent ones come from small
summaries, one of each task, that are added up.

A pre-token begins at a run of spaces or at a line feed. The vocabulary is checked when it is loaded: if a piece could
cross such a border, whole texts are encoded instead.

Defined cases: null and empty texts have 0 bytes and 0 tokens; texts of any length are counted whole; repeated rows
get equal counts; an empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, table, texts_of

#: Pre-tokens in the broadcast table (about 1 MB), in each task's summary, and in a worker's cache.
FREQUENT, SUMMARY, CACHED = 16_384, 4_096, 200_000
PRE_TOKEN = re.compile(r" +[^ \n]*|\n[^ \n]*")


@lru_cache(maxsize=2)
def _model(path: str):
    """The sentencepiece model, and whether texts may be cut at spaces and line feeds."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    space, cut = "▁", True
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        if space in piece.lstrip(space) or "\n" in piece[1:]:
            cut = False
    # No normalization, and one space before the text: what the pre-tokens below rely on.
    probe = "a  b ﬁΩ \t c \n\nd "
    cut = cut and model.decode(model.encode(probe)) == probe and model.encode("a", out_type=str)[0].startswith(space)
    return model, cut


def _plain(text: str) -> str:
    return " " + text.replace("▁", " ")


class Counted:
    """Token counts of texts, with a table of known pre-token lengths and a bounded cache."""

    def __init__(self, path: str, frequent: dict[str, int]):
        self.model, self.cut = _model(path)
        self.frequent, self.cache = frequent, {}
        self.pad = len(self.model.encode("\n")) - 1  # tokens that a line feed's encoding has for the space before it

    def lengths(self, parts: list[str]) -> list[int]:
        """Tokens of pre-tokens. The library puts a space before a text, so one space is taken off here."""
        if not parts:
            return []
        spaced = [p[1:] if p[0] == " " else p for p in parts]
        ids = self.model.encode(spaced, num_threads=1)
        return [(len(x) if s else 1) - (0 if p[0] == " " else self.pad) for p, s, x in zip(parts, spaced, ids, strict=True)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.cut:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        split = [PRE_TOKEN.findall(_plain(t)) if t else [] for t in texts]
        known, cache = self.frequent, self.cache
        if len(cache) > CACHED:
            cache.clear()
        missing = list({p for parts in split for p in parts if p not in known and p not in cache})
        cache.update(zip(missing, self.lengths(missing), strict=True))
        return [sum(known[p] if p in known else cache[p] for p in parts) for parts in split]


@lru_cache(maxsize=1)
def _counted(path: str) -> Counted:
    """One for each worker process: its cache outlives a task."""
    return Counted(path, {})


def frequent_lengths(documents: DataFrame, path: str, frequent: int = FREQUENT) -> dict[str, int]:
    """Lengths of the commonest pre-tokens. Every task reads all its texts and gives its own SUMMARY commonest only."""

    def summary(batches):
        seen: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for t in texts_of(part).to_pylist():
                    seen.update(PRE_TOKEN.findall(_plain(t)))
                if len(seen) > 50 * SUMMARY:
                    seen = Counter(dict(seen.most_common(10 * SUMMARY)))
        top = seen.most_common(SUMMARY)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["part", "n"])

    found = documents.select("text").mapInArrow(summary, "part string, n long").groupBy("part").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "part").limit(frequent)
    parts = [r["part"] for r in found.collect() if len(r["part"]) <= 64]
    return dict(zip(parts, Counted(path, {}).lengths(parts), strict=True))


def count_tokens(documents: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row. path: a sentencepiece model, readable on all machines."""
    known = documents.sparkSession.sparkContext.broadcast(frequent_lengths(documents, path) if _model(path)[1] else {})

    def run(batches):
        counted = _counted(path)
        counted.frequent = known.value
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pa.compute.binary_length(texts), pa.int64()), pa.array(counted.counts(texts.to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
