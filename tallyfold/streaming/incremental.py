"""Reconciliation as files arrive: an extension of the batch surface, which has no streams of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyfold.operators.reconcile import Mapping, Policy, reconcile


def reconcile_arrivals(spark: SparkSession, arriving: DataFrame, reference: DataFrame, mappings: list[Mapping], out: str, checkpoint: str, policy: Policy = Policy()) -> StreamingQuery:
    """Each micro-batch of `arriving`, with all that came before, against `reference`.

    What has arrived is kept in out/arrived and findings go to out/findings, a folder a batch each, so a batch done twice is
    there once. A batch's findings are of all rows so far; keys that only the reference has may still arrive and are left to
    settle().
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/arrived/batch={number}")
        so_far = spark.read.parquet(f"{out}/arrived").filter(F.col("batch") <= number).drop("batch")
        reconcile(so_far, reference, mappings, policy).filter("bucket <> 'ONLY_B'").write.mode("overwrite").parquet(f"{out}/findings/batch={number}")

    return arriving.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settle(spark: SparkSession, reference: DataFrame, mappings: list[Mapping], out: str, policy: Policy = Policy()) -> DataFrame:
    """The findings when nothing more arrives: of all rows that did, and of keys that only the reference has."""
    return reconcile(spark.read.parquet(f"{out}/arrived").drop("batch"), reference, mappings, policy)
