"""Media columns: interleaved document sequences.

HTML is parsed into an ordered sequence of text and media-reference structs. A reference names its payload by digest;
payloads live in a table of their own, one row for each digest, and a join by digest resolves them. Each element keeps
its position and caption, whatever the join does.

Payloads here are lossless 8-bit greyscale images (PNG) of WIDTH samples a row.

Defined cases: null and empty html give an empty sequence; a reference without a payload keeps its place with null
media columns; repeated pages and references each keep their own rows; html of any length is parsed whole.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_join, slices, small_batches, table, written

WIDTH = 192
ELEMENT = "position int, kind string, text string, digest string, caption string"
SEQUENCE = f"array<struct<{ELEMENT.replace(' ', ':').replace(',:', ',')}>>"
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][\w-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S | re.I)
ATTRIBUTE = re.compile(r"([\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
BREAKS = frozenset("p div section article figure h1 h2 h3 h4 h5 h6 li tr br table ul ol blockquote pre".split())
MEDIA = frozenset(("img", "audio", "video", "source"))


def parse(page: str | None) -> list[dict]:
    """The sequence of a page: texts of blocks, and media references with captions (figcaption, else alt)."""
    out: list[dict] = []
    text: list[str] = []
    caption_of, at = None, 0

    def flush() -> None:
        nonlocal text
        joined = " ".join(html_lib.unescape("".join(text)).split())
        text = []
        if joined and caption_of is not None:
            out[caption_of]["caption"] = joined
        elif joined:
            out.append({"position": len(out), "kind": "text", "text": joined, "digest": None, "caption": None})

    last_media = None
    for m in TOKEN.finditer(page or ""):
        text.append(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if name in BREAKS or name in MEDIA or name == "figcaption":
            flush()
        if name in MEDIA and not m[2]:
            have = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(m[4])}
            source = have.get("data-digest") or have.get("src", "").rpartition(":")[2] or None
            last_media = len(out)
            out.append({"position": len(out), "kind": "media", "text": None, "digest": source, "caption": html_lib.unescape(have["alt"]) if have.get("alt") else None})
        elif name == "figure" and not m[2]:
            last_media = None
        elif name == "figcaption":
            caption_of = last_media if not m[2] else None
    text.append((page or "")[at:])
    flush()
    return out


def sequences(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key and sequence of every page."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, html):
                rows = [parse(x) for x in part.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(rows, SEQUENCE_ARROW)], [key, "sequence"])

    return pages.select(key, html).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, sequence {SEQUENCE}")


SEQUENCE_ARROW = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))


def resolve(sequenced: DataFrame, payloads: DataFrame) -> DataFrame:
    """Each media reference as a row, with its payload's columns joined by digest (null where there is none).

    payloads: one row for each digest. Rows keep position and caption, and say of the texts around them how many
    elements there are and, as `texts_sha256`, what their texts are in order. A digest of many references is joined by
    broadcast, so that its references are not brought together.
    """
    keys = [c for c in sequenced.columns if c != "sequence"]
    texts = F.array_join(F.transform(F.filter("sequence", lambda e: e["kind"] == "text"), lambda e: e["text"]), "\n")
    media = F.explode(F.filter("sequence", lambda e: e["kind"] == "media")).alias("_e")
    every = sequenced.select(*keys, F.size("sequence").alias("n_elements"), F.sha2(texts.cast("binary"), 256).alias("texts_sha256"), media)
    references = written(every.select(*keys, "n_elements", "texts_sha256", "_e.position", "_e.caption", F.coalesce("_e.digest", F.lit("")).alias("digest")), "references")
    counts = references.groupBy("digest").agg(F.count("*").alias("_references"))
    facts = written(counts.join(payloads, "digest", "left"), "payloads")
    return keyed_join(references, facts, ["digest"], "_references").drop("_references")


def encode_png(samples: bytes, width: int = WIDTH) -> bytes:
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    raw = np.zeros((len(rows), width + 1), np.uint8)
    raw[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> tuple[int, bytes]:
    """Width and samples of an 8-bit greyscale PNG without row filters."""
    at, width, packed = 8, 0, b""
    while at < len(data):
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("a media payload is damaged")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(-1, width + 1)
    return width, raw[:, 1:].tobytes()


def feature(width: int, samples: bytes) -> str:
    """Size, mean and a histogram of eight levels (in thousandths) of an image."""
    x = np.frombuffer(samples, np.uint8)
    share = np.bincount(x >> 5, minlength=8) * 1000 // max(len(x), 1)
    return f"{width}x{len(x) // width};mean={x.sum(dtype=np.int64) / len(x):.4f};hist={','.join(map(str, share.tolist()))}"


def payload_of(text: bytes) -> bytes:
    return text + b" " * (-len(text) % WIDTH if text else WIDTH)


#: Digests that a task remembers as stored.
KEPT = 1_000_000


def store(texts: DataFrame) -> DataFrame:
    """digest and media of every distinct text, written to the shared folder and read back. texts: digest, text.

    A task stores a digest once; copies in other tasks store the same bytes again, which costs less than to shuffle
    all texts, and `features` keeps one row of each digest.
    """

    def run(batches):
        seen: set[str] = set()
        for batch in batches:
            for part in slices(batch):
                if len(seen) > KEPT:
                    seen.clear()
                rows = {d: t for d, t in zip(part.column("digest").to_pylist(), part.column("text").to_pylist(), strict=True) if d not in seen}
                seen.update(rows)
                media = [encode_png(payload_of((t or "").encode())) for t in rows.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array(media, pa.binary())], ["digest", "media"])

    return written(texts.select("digest", "text").mapInArrow(run, "digest string, media binary"), "media")


def features(media: DataFrame) -> DataFrame:
    """What is computed from the stored bytes of each digest."""

    def run(batches):
        names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            rows = []
            for data in batch.column("media").to_pylist():
                width, samples = decode_png(data)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(width, samples)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    out = media.mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.dropDuplicates(["digest"])


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a page whose figure's payload is the document's own bytes."""
    small_batches(spark)
    text = F.coalesce("text", F.lit(""))
    documents = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.sha2(text.cast("binary"), 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    escaped = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    figure = F.concat(F.lit('<figure><img data-digest="'), F.col("digest"), F.lit('" alt=""><figcaption>'), F.col("n_bytes").cast("string"), F.lit(" bytes</figcaption></figure>"))
    pages = documents.select("doc_id", F.concat(F.lit("<article><p>"), F.replace(escaped, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"), figure, F.lit("</article>")).alias("html"))
    found = resolve(sequences(pages, "doc_id", "html"), features(store(documents)))
    return found.select("doc_id", F.regexp_extract("caption", r"^(\d+)", 1).cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_elements", "texts_sha256", "position", "caption")

