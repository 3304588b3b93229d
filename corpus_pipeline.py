"""A training corpus from raw documents: quality, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. `run` writes each stage's result to the shared folder as Parquet and rereads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webweft.llm.common import table, written
from webweft.llm.decontamination import drop_leaks
from webweft.llm.mixing import mix_stage
from webweft.llm.near_dup import keep_one
from webweft.llm.quality import keep_good
from webweft.llm.token_files import pack_tokens

STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_stage),
    ("token-ID output", pack_tokens),
]

#: Trained models and MinHash have no SQL form; the stages are tested against brute force and held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
