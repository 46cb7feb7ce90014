"""Incremental runs: what a manifest lists is skipped, what is new is processed, appended and then listed.

A run that stops between append and listing is taken up by key: rows already appended for a key are not appended again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.manifest import Manifest
from tessera.sources.readers import _exists


def run_incremental(spark: SparkSession, source: DataFrame, key: str, process: Callable[[DataFrame], DataFrame], output: str, manifest: str) -> bool:
    """Process the keys of ``source`` that aren't listed. ``process`` keeps the key column. Whether there was anything new."""
    listed = Manifest(spark, manifest, f"{key} STRING")
    new = listed.pending(source.withColumn(key, F.col(key).cast("string")))
    if not new.limit(1).count():
        return False
    made = process(new)
    if _exists(spark, output):
        made = made.join(spark.read.schema(made.schema).parquet(output).select(key).distinct(), key, "left_anti")
    made.write.mode("append").parquet(output)
    listed.mark(new)
    return True


def run_stream(spark: SparkSession, folder: str, schema: str, process: Callable[[DataFrame], DataFrame], output: str, checkpoint: str) -> None:
    """All files of ``folder`` not read before, as one available-now stream of JSON lines into Parquet, exactly once."""
    lines = spark.readStream.schema(schema).json(folder)
    process(lines).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(output).awaitTermination()
