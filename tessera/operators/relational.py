"""Keyed, ordered and counting operators. Where order has meaning it is a column (``seq``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def frequency(df: DataFrame, value: Column, seq: Column, name: str = "value") -> DataFrame:
    """(value, n) by falling count, ties by first appearance."""
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n"), F.min(seq).alias("first_seq")).orderBy(F.desc("n"), "first_seq")


def keep_first(df: DataFrame, key: Column, seq: Column) -> DataFrame:
    """The first row of each key by ``seq``; rows without a key count as one key. Pre-aggregated: no window per key.

    A null ``seq`` comes first; of rows alike in ``seq`` one stays, told by its place in the input.
    """
    names = df.columns
    placed = df.select("*", F.coalesce(key, F.lit("")).alias("__key"), F.struct(seq.isNotNull(), seq, F.monotonically_increasing_id()).alias("__at"))
    kept = F.min_by(F.struct(*names), "__at") if names else F.lit(None)
    return placed.groupBy("__key").agg(kept.alias("__row")).select("__row.*")


def jobs(contexts: DataFrame, levels: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Contexts by levels (a few rows, broadcast) without the (chunk_id, level) pairs that are done."""
    every = contexts.crossJoin(F.broadcast(levels.select("level", "ordinal")))
    return every if done is None else every.join(done.select("chunk_id", "level"), ["chunk_id", "level"], "left_anti")


def first_n(df: DataFrame, n: int | None, seq: str) -> DataFrame:
    """The first n rows by ``seq``; 0 or None takes all."""
    return df.orderBy(seq).limit(n) if n else df


def length_stats(df: DataFrame, length: Column, group: list[str] | None = None) -> DataFrame:
    """n, shortest, mean, longest; null on empty input."""
    wanted = [F.count("*").alias("n"), F.min(length).alias("shortest"), F.avg(length).alias("mean"), F.max(length).alias("longest")]
    return df.groupBy(*group).agg(*wanted) if group else df.agg(*wanted)


def drop_accounting(df: DataFrame, text: Column, metadata: Column, damaged: Column, least: int = 100) -> DataFrame:
    """One row: total, short, metadata and ocr, each text in the first that holds."""
    long = F.char_length(text) >= least
    return df.agg(F.count("*").alias("total"), F.count_if(~long).alias("short"), F.count_if(long & metadata).alias("metadata"), F.count_if(long & ~metadata & damaged).alias("ocr"))


def exemplars(pool: DataFrame, k: int, group: str, order: Column) -> DataFrame:
    """At most ``k`` rows of each group, by a deterministic order; ranks are kept to k on the map side."""
    ranked = pool.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(order)))
    return ranked.where(F.col("rank") <= k)


def exemplars_or_any(levels: DataFrame, pool: DataFrame, k: int, order: Column) -> DataFrame:
    """(level, rank, ...) exemplars of each level; a level whose pool is empty takes them from all pools together."""
    own = exemplars(pool, k, "level", order)
    empty = levels.select("level").join(pool.select("level").distinct(), "level", "left_anti")
    every = pool.orderBy(order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(order)))  # k rows
    return own.unionByName(empty.crossJoin(F.broadcast(every.drop("level"))))


def with_level_texts(df: DataFrame, texts: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the columns of a small table by level (broadcast), an empty string for a level it lacks."""
    found = df.join(F.broadcast(texts.select("level", *columns).dropDuplicates(["level"])), "level", "left")
    return found.withColumns({c: F.coalesce(c, F.lit("")) for c in columns})


def group_or(column: str, other: str) -> Column:
    """A grouping column in which null counts as ``other``."""
    return F.coalesce(F.col(column), F.lit(other)).alias(column)
