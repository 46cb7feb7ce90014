"""Keyed tables of finished work: what is done is skipped by an anti-join on typed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.readers import _exists


class Manifest:
    """Append-only keys (and when) under a path; appends are atomic by the task commit protocol."""

    def __init__(self, spark: SparkSession, path: str, keys: str):
        self.spark, self.path, self.keys = spark, path, keys
        self.names = [k.split()[0] for k in keys.split(", ")]

    def done(self) -> DataFrame:
        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.keys)
        return self.spark.read.schema(self.keys).parquet(self.path).distinct()

    def pending(self, df: DataFrame) -> DataFrame:
        return df.join(self.done(), self.names, "left_anti")

    def mark(self, df: DataFrame) -> None:
        df.select(*self.names).distinct().withColumn("at", F.current_timestamp()).write.mode("append").parquet(self.path)


def completed(*sources: DataFrame, column: str) -> DataFrame:
    """Distinct names of several sources."""
    found = sources[0].select(column)
    for s in sources[1:]:
        found = found.union(s.select(column))
    return found.where(F.col(column).isNotNull()).distinct()


def progress_counts(steps: DataFrame) -> DataFrame:
    """Per phase: steps and how many are completed."""
    return steps.groupBy("phase").agg(F.count("*").alias("steps"), F.count_if(F.coalesce("completed", F.lit(False))).alias("completed"))
