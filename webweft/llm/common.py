"""What the operators share: table reading, shared scratch tables, bounded training samples, batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task turns into numpy arrays at a time.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch at most: one value for all operators, since results are lazy.
BATCH_ROWS = 400


def small_batches(spark: SparkSession) -> None:
    """Bound a Python task's memory: lower the session's rows of an Arrow batch to BATCH_ROWS if they are more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A session of one machine without one gets a local one; a cluster must name it."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-webweft-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/webweft-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_of_id(doc_id: Column) -> Column:
    """Unsigned crc32 of the id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def bounded_sample(rows: DataFrame, label: str, per_class: int) -> DataFrame:
    """About per_class rows of each value of label at most, chosen by a hash of doc_id.

    Values of label are counted in Spark and joined by a broadcast of those of many rows only: a class of at most
    per_class rows is kept whole, and there are at most (all rows / per_class) others.
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("_n")).filter(F.col("_n") > per_class)
    share = counts.select(F.col(label).alias("_label"), (per_class / F.col("_n")).alias("_share"))
    dealt = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    both = rows.join(share, F.col(label).eqNullSafe(F.col("_label")), "left")
    return both.filter(F.col("_share").isNull() | (dealt < F.col("_share"))).select(*rows.columns)


def training_texts(documents: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int) -> list[tuple[str, int]]:
    """(text, label) of a bounded sample of labelled training rows, in the order of doc_id and text.

    Null labels and ids are left out; a doc_id with several labels counts once, with the least; of a doc_id with
    several texts the least counts.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("_y")).filter(train)
    chosen = bounded_sample(known, "_y", per_class)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_y").agg(F.min("text").alias("text"))
    return [(r["text"] or "", int(r["_y"])) for r in sorted(rows.collect(), key=lambda r: r["doc_id"])]


#: Rows that may be broadcast: counted first.
BROADCAST_ROWS = 500_000


def small_or_not(facts: DataFrame) -> DataFrame:
    """A table of short rows, marked for broadcast if it has BROADCAST_ROWS rows at most; else it is shuffled."""
    return F.broadcast(facts) if facts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else facts


#: A key of more than one in HEAVY of all rows is heavy; so there are at most HEAVY of them.
HEAVY = 5000


def keyed_join(rows: DataFrame, facts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows inner joined to facts, which has one row a key and, in `count`, how many of rows have it.

    Heavy keys would land in one task each: their facts, at most HEAVY rows, are broadcast, and their rows are not
    shuffled; all other rows meet their facts by key. facts: a written table, since it is read three times.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    is_heavy = F.col(count) > max(1, total // HEAVY)
    heavy = facts.filter(is_heavy)
    here = F.broadcast(heavy.select(*keys, F.lit(True).alias("_heavy")))
    light = rows.join(here, keys, "left_anti").join(facts.filter(~is_heavy), keys)
    return light.unionByName(rows.join(F.broadcast(heavy), keys))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `most` bytes of text; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return pc.fill_null(batch.column(column), "").cast(pa.large_string())
