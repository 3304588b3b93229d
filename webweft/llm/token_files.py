"""Token-ID files in patched frame-of-reference blocks, written in doc_id order and read back.

Documents are dealt into ranges of doc_id and sorted; each range is a run of segments. A segment holds the ids of some
documents, in blocks of BLOCK ids: the block's minimum is subtracted, the rest is packed at the width that PERCENTILE
of its ids need, and the others go to an exception list (position and full value). An index gives each block's start
in the segment's bytes, so that a block can be read alone. Segments are rows of a Parquet table in the shared folder,
so that Spark's own committer makes the files appear whole, whatever executors are lost.

Segment layout, little-endian: counts of ids, documents and blocks (u32 each); block starts (u32 each, and the end);
then per block minimum (u32), width (u8), ids (u16), exceptions (u16), packed ids, exception positions (u16) and
values (u32). Lengths of documents are a list column beside the bytes.

Defined cases: null and empty texts have only the end id; a row without doc_id sorts first; rows of one
doc_id are in the order of a hash of their texts; repeated rows are kept, each with its own place; an empty table gives empty files. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices, small_batches, table, texts_of, written

BLOCK, PERCENTILE, CACHED = 256, 90, 1_200_000
END_ID = 2
END = END_ID.to_bytes(4, "little")
#: The cut at white space that the tokenizer makes.
PRE_TOKEN = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Fixed value: the byte-level tokenizer's own cut of a text into words.
PART = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words of these characters are cut as above; tables of other characters may differ, so other words go in one piece.
PLAIN = re.compile("[ !-~\xa1-\u024f]+")
#: A part that holds no white space but one space before it.
ONE = re.compile(r" ?[^\s\x1c-\x1f]+")
#: A word that is one part.
LETTERS = re.compile("[ ]?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: Texts that may hold a special token, or white space on which the cuts could differ, go to the library whole.
ODD = re.compile(r"[\x1c-\x1f]|<\|")
#: Other texts are cut at each space and line feed, unless they hold other white space or runs of it.
UNEVEN = r"[ \n]{2}|[\t\r\f\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<\|"
#: Words that go to the library as one text; longer texts take it more time a word.
TOGETHER = 64
#: Bytes of text that are cut and looked up at a time.
SLICE_BYTES = 1 << 22
SEGMENT_SCHEMA = "range int, segment int, before long, n_ids long, doc_ids array<long>, lengths array<int>, bytes binary"


class Encoder:
    """Ids of texts: words come from a bounded cache, which the tokenizers library fills.

    Arrow cuts a slice of texts and numbers its distinct words; each distinct word is looked up once, and the ids of
    all texts are gathered by number.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.cuts = _cuts_as_expected(self.library)
        self.cache: dict[str, bytes] = {}
        self.line = self._whole("\n")
        (self.line_feed,) = np.frombuffer(self.line, "<u4")

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """uint32 ids of each text with the end id."""
        if len(self.cache) > CACHED:
            self.cache.clear()
        if not self.cuts:
            return [np.frombuffer(self._whole(t) + END, "<u4") for t in texts.to_pylist()]
        uneven = pc.match_substring_regex(texts, UNEVEN)
        out = self._even(pc.if_else(uneven, "", texts))
        for i in np.flatnonzero(uneven.to_numpy(zero_copy_only=False)):
            t = texts[i].as_py()
            if ODD.search(t):
                ids = self._whole(t)
            else:
                ids = b"".join(self._known(PRE_TOKEN.findall(t)))
            out[i] = np.frombuffer(ids + END, "<u4")
        return out

    def _even(self, texts: pa.Array) -> list[np.ndarray]:
        """Texts whose white space is single spaces and line feeds: cut into lines, and these into words."""
        lines = pc.split_pattern(texts, "\n")
        words = pc.split_pattern(lines.flatten(), " ")
        text_ends, line_ends = (x.offsets.to_numpy()[1:] - x.offsets[0].as_py() for x in (lines, words))
        numbered = words.flatten().dictionary_encode()
        # A word that does not begin its line has its space before it.
        slot = numbered.indices.to_numpy().astype(np.int64) * 2
        slot[np.concatenate([[0], line_ends[:-1]])[: len(line_ends)]] += 1
        present = np.zeros(2 * len(numbered.dictionary), bool)
        present[slot] = True
        used, names = np.flatnonzero(present), numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        keys = [names[k >> 1] if k & 1 else " " + names[k >> 1] for k in used.tolist()]
        found = [*self._known(keys), self.line, END]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, flat = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(found), "<u4")
        after = np.full(len(line_ends), len(used))
        after[text_ends - 1] = len(used) + 1
        entry = np.insert((np.cumsum(present) - 1)[slot], line_ends, after)
        many = lengths[entry]
        stop = np.cumsum(many)
        ids = flat[np.repeat(starts[entry] - stop + many, many) + np.arange(int(many.sum()))]
        # Copies, so that a text kept does not keep the slice.
        return [x.copy() for x in np.split(ids, stop[line_ends[text_ends - 1] + text_ends - 1][:-1])] if len(texts) else []

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of each word."""
        found = list(map(self.cache.get, words))
        absent = [i for i, ids in enumerate(found) if ids is None]
        if absent:
            self._learn({words[i] for i in absent})
        for i in absent:
            found[i] = self.cache[words[i]]
        return found

    def _learn(self, missing: set[str]) -> None:
        """Words are cut into parts, which other words share; new parts are encoded."""
        whole = {w for w in missing if LETTERS.fullmatch(w) or not PLAIN.fullmatch(w)}
        cut = [(w, PART.findall(w)) for w in missing.difference(whole)]
        self._encode(whole | {p for _, found in cut for p in found}.difference(self.cache))
        for w, found in cut:
            if len(found) != 1:
                self.cache[w] = b"".join(map(self.cache.__getitem__, found))

    def _encode(self, parts: set[str]) -> None:
        """Parts without inner white space are encoded in one text, a line feed after each; others one by one."""
        words = [p for p in parts if ONE.fullmatch(p)]
        for p in parts.difference(words):
            self.cache[p] = self._whole(p)
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for group, found in zip(groups, self.library.encode_batch_fast(["\n".join(g) + "\n" for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(ids == self.line_feed)
            if len(ends) != len(group):
                raise ValueError("the tokenizer does not keep line feeds apart")
            raw, at = ids.tobytes(), 0
            for p, end in zip(group, (4 * ends).tolist(), strict=True):
                self.cache[p] = raw[at:end]
                at = end + 4


def _cuts_as_expected(library) -> bool:
    """Whether the file's own cut is that of PART and nothing is done to texts before it; else texts go whole."""
    file = json.loads(library.to_str())
    cut = file.get("pre_tokenizer") or {}
    return cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and file.get("normalizer") is None


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for each worker process: its cache outlives a task."""
    return Encoder(path)


def pack(ids: np.ndarray, documents: int = 0) -> bytes:
    """A segment's bytes (without the documents' lengths)."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    parts: list[bytes | None] = [None] * blocks
    for rows, size in ((np.arange(n // BLOCK), BLOCK), (np.array([blocks - 1]) if n % BLOCK else np.zeros(0, int), n % BLOCK)):
        if not len(rows):
            continue
        values = ids[rows[0] * BLOCK : rows[0] * BLOCK + len(rows) * size].reshape(len(rows), size)
        low = values.min(1)
        rest = values - low[:, None]
        at = min(size - 1, (size * PERCENTILE + 99) // 100 - 1)
        width = np.frexp(np.partition(rest, at, 1)[:, at].astype(float))[1]
        for w in np.unique(width).tolist():
            some = np.flatnonzero(width == w)
            v = np.ascontiguousarray(rest[some], "<u4")
            over = v >> np.uint32(w) > 0 if w < 32 else np.zeros(v.shape, bool)
            bits = np.unpackbits(v.view(np.uint8).reshape(len(some), size, 4), axis=2, count=w, bitorder="little") if w else np.zeros((len(some), 0), np.uint8)
            packed = np.packbits(bits.reshape(len(some), -1), axis=1, bitorder="little")
            places, values_over, until = np.nonzero(over)[1].astype("<u2").tobytes(), v[over].tobytes(), np.cumsum(over.sum(1)).tolist()
            before = 0
            for row, least, data, end in zip(rows[some].tolist(), low[some].tolist(), packed, until, strict=True):
                parts[row] = struct.pack("<IBHH", least, w, size, end - before) + data.tobytes() + places[2 * before : 2 * end] + values_over[4 * before : 4 * end]
                before = end
    starts = np.cumsum([12 + 4 * (blocks + 1), *map(len, parts)]).astype("<u4")
    return struct.pack("<III", n, documents, blocks) + starts.tobytes() + b"".join(parts)


def _blocks(segment: bytes, start: np.ndarray, heads: np.ndarray, w: int, size: int) -> np.ndarray:
    """The ids of blocks of one width and size that start at these bytes, one row each; heads: minimum, exceptions."""
    length, groups = (size * w + 7) // 8, -(-size // 8)
    v = np.zeros((len(start), groups * 8), "<u4")
    if w:
        # Eight values take w whole bytes; value j of each eight is put together from the bytes that hold its bits.
        data = np.zeros((len(start), groups * w), np.uint8)
        data[:, :length] = np.frombuffer(segment, np.uint8)[start[:, None] + 9 + np.arange(length)]
        column = np.ascontiguousarray(data.reshape(-1, w).T, np.uint64)
        eights = v.reshape(-1, 8)
        for j in range(8):
            first, last = j * w // 8, ((j + 1) * w - 1) // 8
            value = column[first].copy()
            for k in range(first + 1, last + 1):
                value |= column[k] << np.uint64(8 * (k - first))
            eights[:, j] = value >> np.uint64(j * w % 8) & np.uint64((1 << w) - 1)
    v = v[:, :size]
    for row, at, many in zip(v, (start + 9 + length).tolist(), heads[:, 1].tolist(), strict=True):
        if many:
            row[np.frombuffer(segment, "<u2", many, at)] = np.frombuffer(segment, "<u4", many, at + 2 * many)
    return v + heads[:, :1].astype("<u4")


def _read_blocks(segment: bytes, first: int, last: int) -> np.ndarray:
    bounds = np.frombuffer(segment, "<u4", last - first + 1, 12 + 4 * first).astype(np.int64)
    heads = np.array([struct.unpack_from("<IBHH", segment, at) for at in bounds[:-1].tolist()], np.int64).reshape(-1, 4)
    low_many, w, size = heads[:, [0, 3]], heads[:, 1], heads[:, 2]
    if (bounds[:-1] + 9 + (size * w + 7) // 8 + 6 * heads[:, 3] != bounds[1:]).any():
        raise ValueError("a block of token ids is damaged")
    out: list[np.ndarray | None] = [None] * len(w)
    for kind in np.unique(w * 65536 + size).tolist():
        some = np.flatnonzero(w * 65536 + size == kind)
        for i, ids in zip(some.tolist(), _blocks(segment, bounds[some], low_many[some], kind >> 16, kind & 65535), strict=True):
            out[i] = ids
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def unpack_block(segment: bytes, block: int) -> np.ndarray:
    """The ids of one block, found by the index."""
    return _read_blocks(segment, block, block + 1)


def unpack(segment: bytes) -> np.ndarray:
    """All ids of a segment."""
    n, _, blocks = struct.unpack_from("<III", segment)
    out = _read_blocks(segment, 0, blocks)
    if len(out) != n:
        raise ValueError("a segment of token ids is damaged")
    return out


def write(documents: DataFrame, path: str, segment_ids: int = 1 << 18) -> DataFrame:
    """Encode and write; returns the table of segments as read back from the shared folder. path: a tokenizers file."""
    spark = documents.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A hash of the text parts rows of one doc_id, or without one, into several ranges.
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    rows = documents.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, number = _encoder(path), TaskContext.get().partitionId()
        segment = before = total = 0
        ids, docs = [], []

        def full():
            flat = np.concatenate(ids)
            row = {"range": number, "segment": segment, "before": before, "n_ids": len(flat), "doc_ids": docs, "lengths": [len(x) for x in ids], "bytes": pack(flat, len(docs))}
            return pa.RecordBatch.from_pylist([row], schema=SEGMENT_ARROW)

        for batch in batches:
            for part in slices(batch, most=SLICE_BYTES):
                for doc, x in zip(part.column("doc_id").to_pylist(), encoder.encode(texts_of(part)), strict=True):
                    ids.append(x)
                    docs.append(doc)
                    total += len(x)
                    if total >= segment_ids:
                        yield full()
                        segment, before, total, ids, docs = segment + 1, before + total, 0, [], []
        if ids:
            yield full()

    return written(dealt.mapInArrow(run, SEGMENT_SCHEMA), "token-ids")


SEGMENT_ARROW = pa.schema([("range", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("bytes", pa.binary())])


def read(segments: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document, from the stored bytes."""
    # One row for each range (no more than shuffle partitions), small enough to broadcast: their running total places a range; within it the segments hold their own.
    totals = segments.groupBy("range").agg(F.sum("n_ids").alias("n"))
    order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    places = totals.select("range", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))

    def run(batches):
        _encoder.cache_clear()  # a worker that reads needs no words
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = unpack(row["bytes"]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                crc = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(ends, row["lengths"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["base"] + row["before"] + ends - row["lengths"], pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.join(F.broadcast(places), "range").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    return read(write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: token-ID files of all documents, and where each document is in them."""
    import public_tokenizers

    small_batches(spark)
    return read(write(docs, public_tokenizers.path("byte_bpe_50k.json")))
