"""Document fingerprints by winnowing: k-gram hashes, the least of every window, the rightmost of equal ones, with positions.

All of it is DataFrame functions. A text is read as its UTF-8 bytes. Every run of GRAM bytes is hashed as the gram rolls
on by a byte; of every WINDOW grams in a row the least hash is kept, so that two texts that share GUARANTEE bytes in a
row share a hash, at positions that show where, while runs shorter than GRAM never match. A hash and its position are
one number, the hash above the position counted down: the least number is the rightmost least hash.

A window of twice BLOCK grams holds one whole aligned block of BLOCK grams, so only grams that are no more than the
least of a block near them can be kept. These candidates, one in seventeen, are compared with their neighbours; the
others are read once. Texts are read in pieces of PIECE windows: no array is longer, however long a text.

The kept grams of a prefix are known from those of the text, since each is kept from a certain window on. So the
fingerprint of an edited text (a prefix of one and a prefix of another document) is put together from both and from the
windows across the seam, and equals the fingerprint of the edited text itself.

A document's successor is found without a total order in one task: ids are dealt into blocks of neighbouring ids, by
percentiles and evenly between them, and the first row of each block also stands at the end of the block before.

Defined cases: null texts are empty; an empty text has an empty fingerprint, a shorter one than a gram one hash; two
empty fingerprints are alike (1), an empty and another are not (0); rows of one id follow by text, null ids come last;
the only row follows itself; an empty table gives an empty result. doc_id is taken for a near unique key: rows of one
id are ordered in one task. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webweft.functions.text import let

from .common import table, written

GRAM, WINDOW, BLOCK, PIECE = 32, 64, 32, 8192
#: Bytes in a row that two texts must share to be sure to share a hash.
GUARANTEE = GRAM + WINDOW - 1
#: Positions count down from here, in the low bits; the hash's high bits stand above.
LAST = 2**31 - 1
#: Candidates at either side that are looked at first; a window holds fewer but in odd texts.
NEAR = 8


def position(kept: Column) -> Column:
    return LAST - kept.bitwiseAND(F.lit(LAST))


def hash_of(kept: Column) -> Column:
    return F.shiftrightunsigned(kept, 31)


def _kept(data: Column, begin: Column, end: Column) -> Column:
    """The kept grams of the windows within grams begin to end - 1 (absolute, at least one), in the order of windows."""
    grams = F.transform(F.sequence(begin, end - 1), lambda i: F.xxhash64(F.substr(data, i + 1, F.lit(GRAM))).bitwiseOR(F.lit(LAST)) - i)

    def of_grams(g: Column) -> Column:
        least = F.transform(F.sequence(F.lit(1), F.size(g), F.lit(BLOCK)), lambda i: F.array_min(F.slice(g, i, BLOCK)))
        near = let(least, lambda m: F.transform(m, lambda x, j: F.greatest(x, F.get(m, j - 1), F.get(m, j + 1))))
        return let(near, lambda b: let(F.filter(g, lambda x, i: x <= F.get(b, F.shiftright(i, 5))), lambda c: F.filter(c, lambda x, q: wins(c, x, q, F.least(F.size(g), F.lit(WINDOW))))))

    def wins(c: Column, x: Column, q: Column, window: Column) -> Column:
        """Whether some window lies between the lesser grams on both sides."""
        at = position(x)
        clear = (position(F.get(c, q - NEAR)) > at - WINDOW) | (position(F.get(c, q + NEAR)) < at + WINDOW)
        reach = F.when(clear, WINDOW).otherwise(NEAR)
        lesser = lambda some: F.transform(F.filter(some, lambda y: y < x), position)
        left = lambda n: F.coalesce(F.array_max(lesser(F.slice(c, F.greatest(q - n + 1, F.lit(1)), F.least(q, n)))), begin - 1)
        right = lambda n: F.coalesce(F.array_min(lesser(F.slice(c, q + 2, n))), end)
        return let(reach, lambda n: right(n) - left(n) > window)

    return let(grams, of_grams)


def winnow(data: Column) -> Column:
    """Array of the kept grams of a binary, in the order of the windows that keep them."""

    def whole(b: Column) -> Column:
        count = F.greatest(F.octet_length(b) - (GRAM - 1), F.lit(1))
        windows = F.greatest(count - (WINDOW - 1), F.lit(1))
        pieces = F.transform(F.sequence(F.lit(0), windows - 1, F.lit(PIECE)), lambda s: let(F.least(s + (PIECE + WINDOW - 1), count), lambda e: _kept(b, s, e)))
        return F.when(F.octet_length(b) > 0, F.array_distinct(F.flatten(pieces))).otherwise(F.array().cast("array<bigint>"))

    return let(data, whole)


def of_prefix(kept: Column, size: Column) -> Column:
    """The kept grams of the first `size` bytes (GUARANTEE at least), from those of the whole."""

    def first_window(x: Column, n: Column, all_kept: Column) -> Column:
        before = F.get(all_kept, n - 1)
        return F.when(before.isNull(), 0).when(x < before, position(x) - (WINDOW - 1)).otherwise(position(before) + 1)

    return let(F.struct(kept.alias("kept"), (size - GUARANTEE).alias("last")), lambda a: F.filter(a["kept"], lambda x, n: first_window(x, n, a["kept"]) <= a["last"]))


def joined(first: Column, first_size: Column, second: Column, second_size: Column, seam: Column) -> Column:
    """The kept grams of two texts in a row. first, second: kept grams that begin with those of the texts, whose bytes
    are counted in the sizes; seam: the last GUARANTEE - 1 bytes of the first and as many first ones of the second."""
    none = F.array().cast("array<bigint>")
    begin = F.greatest(first_size - (GUARANTEE - 1), F.lit(0))
    moved = lambda kept, by: let(F.struct(kept.alias("kept"), by.alias("by")), lambda a: F.transform(a["kept"], lambda x: x - a["by"]))
    of_first = F.when(first_size >= GUARANTEE, of_prefix(first, first_size)).otherwise(none)
    of_second = F.when(second_size >= GUARANTEE, moved(of_prefix(second, second_size), first_size)).otherwise(none)
    across = F.when((F.octet_length(seam) >= GUARANTEE) | (first_size + second_size < GUARANTEE), moved(winnow(seam), begin)).otherwise(none)
    return F.array_distinct(F.concat(of_first, across, of_second))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints' hashes."""
    sets = F.struct(F.transform(a, hash_of).alias("a"), F.transform(b, hash_of).alias("b"))
    alike = lambda s: F.size(F.array_intersect(s["a"], s["b"])) / F.size(F.array_union(s["a"], s["b"]))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(let(sets, alike))


def shown(kept: Column) -> Column:
    """Hashes in hexadecimal digits, each with its position in bytes."""
    return F.array_join(F.transform(kept, lambda x: F.concat(F.lower(F.hex(hash_of(x))), F.lit("@"), position(x).cast("string"))), " ")


#: Rows of a block of neighbours, if that makes no more than MOST blocks; percentiles that part the ids first.
BLOCK_ROWS, MOST_BLOCKS, PERCENTILES = 64, 400_000, 256


def id_blocks(rows: DataFrame, key: str) -> Column:
    """A block number for every value of key (long), rising with it; blocks have about BLOCK_ROWS rows."""
    n, cuts = rows.agg(F.count("*"), F.percentile_approx(key, [i / PERCENTILES for i in range(PERCENTILES + 1)], 10_000)).first()
    cuts = sorted({*(cuts or [])})
    inner = max(1, -(-min(-(-n // BLOCK_ROWS), MOST_BLOCKS) // max(1, len(cuts))))
    if not cuts:
        return F.lit(0)
    bounds = F.array(*(F.lit(c).cast("long") for c in cuts))
    part = F.size(F.filter(bounds, lambda c: c <= F.col(key)))
    low, high = F.get(bounds, part - 1), F.get(bounds, part)
    within = F.floor((F.col(key).cast("double") - low) * inner / (high.cast("double") - low))
    return part * inner + F.least(F.greatest(F.coalesce(within, F.lit(0)), F.lit(0)), F.lit(inner - 1)).cast("int")


def with_next(documents: DataFrame) -> DataFrame:
    """doc_id, text, kept of every document and the text and kept of the next one, by descending id; the first is next to
    the last."""
    least = F.lit(-(2**63)).cast("long")
    rows = documents.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), least).alias("_key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_block", id_blocks(rows, "_key"))
    heads = rows.groupBy("_block").agg(F.max("_key").alias("_key"))
    # MOST_BLOCKS rows of three numbers at most, however many documents.
    around = Window.orderBy("_block")
    to = F.coalesce(F.lead("_block").over(around), F.min("_block").over(Window.partitionBy(F.lit(0))))
    heads = written(heads.withColumn("_to", to), "heads")
    again = rows.join(F.broadcast(heads), ["_block", "_key"]).select("doc_id", "_key", "text", F.col("_to").alias("_block"), F.lit(True).alias("_again"))
    every = rows.withColumn("_again", F.lit(False)).unionByName(again).withColumn("kept", winnow(F.col("text").cast("binary")))
    order = Window.partitionBy("_block").orderBy("_again", F.desc("_key"), "text")
    return every.withColumn("next", F.lead(F.struct("text", "kept")).over(order)).filter("NOT _again").select("doc_id", "text", "kept", "next")


def fingerprints(documents: DataFrame) -> DataFrame:
    """The contract's columns for every document: its fingerprint, that of its edited text, and their likeness."""
    half = F.floor(F.length("text") / 2).cast("int")
    rows = with_next(documents).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("head", F.left("text", F.col("n_chars").cast("int") - half).cast("binary")).withColumn("tail", F.left("next.text", half).cast("binary"))
    rows = rows.withColumn("head_size", F.octet_length("head")).withColumn("tail_size", F.octet_length("tail"))
    seam = F.concat(F.substr("head", F.greatest(F.col("head_size") - (GUARANTEE - 2), F.lit(1)), F.lit(GUARANTEE - 1)), F.substr("tail", F.lit(1), F.lit(GUARANTEE - 1)))
    edited = joined(F.col("kept"), F.col("head_size"), F.col("next.kept"), F.col("tail_size"), seam)
    rows = rows.select("doc_id", "n_chars", F.sha2(F.concat("head", "tail"), 256).alias("edited_sha256"), "kept", F.col("next.kept").alias("next_kept"), edited.alias("edited"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(F.col("kept")).alias("fingerprint"),
        shown(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("kept"), F.col("edited")).alias("near_edited"),
        likeness(F.col("kept"), F.col("next_kept")).alias("near_next"),
    )


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
