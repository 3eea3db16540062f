"""From raw documents to packed sequences: quality, exact copies, near copies, benchmark passages, packing.

Each stage takes what the one before has written and returns the columns of documents, the last the packed pieces. A judgement
that only concerns some rows drops these and keeps every other row as it is.

Null and empty texts pass the quality stage where the share of good labels does, are one text for the exact stage, and are packed
as their closing id. Rows that repeat are one by the exact stage; a null doc_id stays null. Further columns of documents are left
out, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import decontam, exact, minhash, packing, quality
from tallyfold.llm.common import _at_exit, delete, exists, scope, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(*COLUMNS), model, "_score").filter(F.col("_score") >= quality.THRESHOLD).select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    return exact.keep(docs.select(*COLUMNS))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id."""
    return minhash.keep(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark: one verbatim window is a leak however long the document."""
    return decontam.keep_clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(docs))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the fitted classifier nor tokenisation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """All stages, one after another. What a stage writes on the way is removed as it ends, its input when the next has ended.

    A run with an id goes on after the last stage that a run of this id has finished, and its result stays; without one the
    result goes with the session.
    """
    at = f"{shared_dir(spark).rstrip('/')}/pipeline-{run_id or uuid.uuid4().hex}"
    if run_id is None:
        atexit.register(_at_exit, spark, at)
    done = max((k for k in range(len(STAGES)) if exists(spark, f"{at}/{k}/_SUCCESS")), default=-1)
    docs = spark.read.parquet(f"{at}/{done}" if done >= 0 else f"{sf_dir}/documents.parquet")
    for k in range(done + 1, len(STAGES)):
        with scope(spark):
            STAGES[k][1](spark, docs, sf_dir).write.mode("overwrite").parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:
            delete(spark, f"{at}/{k - 1}")
    return docs
