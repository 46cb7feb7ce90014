"""Helpers shared by the training-data operators: shared-folder materialisation, text columns, input tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``. Where that is unset a temporary one serves a session on one machine; a cluster's raises."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage, survives lost executors and pins nondeterministic columns (row ids).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_place(df: DataFrame, path: str, row: str, name: str = "rows") -> DataFrame:
    """``df`` with the file and the place in it of every row, which tell rows apart; a table not read from files is written first."""
    try:
        return df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(row))
    except AnalysisException:
        kept = materialise(df, name)
        return kept.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(row))


def in_file_order(df: DataFrame) -> DataFrame:
    """Rows of a table of Spark's Parquet files by the files' numbers and the place in the file, over ascending tasks; any other table as it is."""
    path = F.col("_metadata.file_path")
    place = [fresh(df, c) for c in ("file_number", "file_path", "row_place")]
    try:
        placed = df.select("*", F.regexp_extract(path, r"part-(\d+)[^/]*$", 1).try_cast("long").alias(place[0]), path.alias(place[1]), F.col("_metadata.row_index").alias(place[2]))
    except AnalysisException:  # not read from files
        return df
    return placed.repartitionByRange(partitions(df.sparkSession), *place).sortWithinPartitions(*place).drop(*place)


def sums_before(df: DataFrame, keys: list[str], order: str, value: str, group: Column) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows of the same ``keys`` that precede by ``order``.

    ``group`` rises with ``order``: its sums are taken first, then those within it, so that no task has all rows.
    """
    ahead = lambda w, v: F.coalesce(F.sum(v).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = df.withColumn("within_group", group)
    inner = rows.withColumn("inner_sum", ahead(W.partitionBy(*keys, "within_group").orderBy(order), value))
    every = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    outer = rows.groupBy(*keys, "within_group").agg(F.sum(value).alias("group_sum"))
    outer = outer.withColumn("outer_sum", ahead(every.orderBy("within_group"), "group_sum")).select(*(F.col(k).alias(f"outer_{k}") for k in keys), F.col("within_group").alias("outer_group"), "outer_sum")
    on = F.col("within_group") == F.col("outer_group")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"outer_{k}"))
    return inner.join(outer, on).select(*df.columns, (F.col("inner_sum") + F.col("outer_sum")).alias("before"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; ``lower`` is much the faster of the two and does the same for texts of one byte a character."""
    translated = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(translated)


def without(docs: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """``docs`` without the rows that ``seen`` (doc_id, ``key``, kept) drops.

    A row is named by its doc_id and ``key``, a digest of its text; of rows alike in both, one stays if one is kept.
    """
    stay = seen.where("kept").select("doc_id", key)
    gone = seen.where("not kept").select("doc_id", key)
    named = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a[key] == b[key])
    repeated = gone.join(stay, named(gone, stay), "left_semi")
    gone = gone.join(stay, named(gone, stay), "left_anti").distinct()
    left = docs.join(gone.hint("merge"), named(docs, gone), "left_anti")  # one plan at every size: ids grow with the input
    return left.dropDuplicates(["doc_id", key]) if repeated.limit(1).count() else left
