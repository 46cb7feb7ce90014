"""Sources: file discovery, JSON lines (strict, tolerant), JSON arrays, format sniffing, unions, parsed documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def discover_files(spark: SparkSession, folders: list[str], pattern: str = "*.pdf") -> DataFrame:
    """(folder, path, name, modified, size) of the files directly in each folder that exists, by folder order, then path."""
    found = None
    for i, folder in enumerate(f for f in folders if _exists(spark, f)):
        one = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
        one = one.select(F.lit(i).alias("folder"), "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "folder INT, path STRING, name STRING, modified TIMESTAMP, size LONG")
    return found.orderBy("folder", "path")


def parse_files(spark: SparkSession, folders: list[str], parser: Callable[[str, bytes], str | None], pattern: str = "*.pdf", least: int = 100) -> DataFrame:
    """(path, markdown): each file's parsed text, null where the parser fails or gives under ``least`` trimmed characters."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    text = parser(path, bytes(content))
                except Exception:  # a parser's failure is one file's
                    text = None
                made.append(text if text is not None and len(text.strip()) >= least else None)
            yield pd.DataFrame({"path": frame["path"], "markdown": made})

    there = [f for f in folders if _exists(spark, f)]
    if not there:
        return spark.createDataFrame([], "path STRING, markdown STRING")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(there)
    return files.select("path", "content").mapInPandas(run, "path STRING, markdown STRING")


def with_cache(spark: SparkSession, files: DataFrame, cache_path: str, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(path, markdown) of ``files`` from the cache table, keyed by full path; misses are parsed and appended first."""
    schema = "path STRING, markdown STRING"
    cached = spark.read.schema(schema).parquet(cache_path) if _exists(spark, cache_path) else spark.createDataFrame([], schema)
    parse(files.join(cached, "path", "left_anti")).select("path", "markdown").where("markdown IS NOT NULL").write.mode("append").parquet(cache_path)
    return spark.read.schema(schema).parquet(cache_path).join(files.select("path"), "path", "left_semi")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a bad line fails the read, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without the blank and corrupt ones."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def corrupt_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines that the tolerant reader leaves out: not blank, and no record of the schema."""
    told = spark.read.schema(f"{schema}, corrupt STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)
    return told.select(F.col("corrupt").alias("line"), F.lit(0).alias("one")).where("line IS NOT NULL").select("line")


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of the paths that there is."""
    return next((p for p in paths if _exists(spark, p)), None)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array if the first character that isn't white space is ``[``, else JSON lines."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    array = bool(first) and first[0]["value"].lstrip().startswith("[")
    return read_json_array(spark, path, schema) if array else read_jsonl(spark, path, schema)


def read_union(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All JSON-array files of a glob, with ``file`` (for order) and ``seq`` (rising in file, then row)."""
    rows = spark.read.schema(schema).option("multiLine", True).json(pattern).select("*", F.col("_metadata.file_path").alias("file"))
    return rows.withColumn("seq", F.struct("file", F.monotonically_increasing_id().alias("row")))


def read_results(spark: SparkSession, path: str, predictions: bool = False) -> DataFrame:
    """Saved benchmark results; ``predictions`` are left out unless asked for."""
    rows = spark.read.parquet(path)
    return rows if predictions else rows.drop("predictions")
