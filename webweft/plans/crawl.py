"""The crawl as a fixpoint over a link table: least depths with edges of weight 0 and 1, one level at a time."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _root(spark: SparkSession) -> str:
    """The folder that all executors share; only a session of one machine may go without."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-webweft-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/webweft-crawl-{uuid.uuid4().hex}"


def crawl_depths(seeds: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """url and least depth of all that is reached within max_depth. seeds: url; edges: src, dst, weight (0 or 1).

    Within a level edges of weight 0 are closed over first; a URL keeps the depth at which it is first reached. Edges
    are written once, parted by weight; every step appends its new rows as a folder of its own, so that nothing is
    written twice and a lost executor costs one step only.
    """
    spark, root = seeds.sparkSession, _root(seeds.sparkSession)
    least = edges.filter("src <> dst").groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    least.write.partitionBy("weight").parquet(f"{root}/edges")
    known = spark.read.schema("src string, dst string, weight int").parquet(f"{root}/edges")
    steps: list[str] = []

    def read(paths: list[str]) -> DataFrame:
        return spark.read.schema("url string, depth int").parquet(*paths)

    def append(rows: DataFrame, depth: int) -> bool:
        """Write the new URLs of a step; whether there are any."""
        path = f"{root}/step-{uuid.uuid4().hex}"
        rows.withColumn("depth", F.lit(depth)).write.parquet(path)
        if read([path]).isEmpty():
            return False
        steps.append(path)
        return True

    def beyond(paths: list[str], weight: int) -> DataFrame:
        """What edges of a weight lead to from these steps and is not found yet."""
        ends = read(paths).join(known.filter(F.col("weight") == weight), F.col("url") == F.col("src"))
        return ends.select(F.col("dst").alias("url")).distinct().join(read(steps), "url", "left_anti")

    if not append(seeds.select("url").distinct(), 0):
        return spark.createDataFrame([], "url string, depth int")
    begin = 0
    for depth in range(max_depth + 1):
        last = begin
        while last < len(steps) and append(beyond(steps[last:], 0), depth):
            last = len(steps) - 1
        level, begin = steps[begin:], len(steps)
        if depth == max_depth or not append(beyond(level, 1), depth + 1):
            break
    return read(steps)
