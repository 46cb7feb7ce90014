"""Sinks: JSON lines, JSON array by suffix, appends, partitioned output, summary."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines in UTF-8, nulls kept, overwriting."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_records(df: DataFrame, path: str, most: int = 100_000) -> None:
    """``.json``: one indented array, for small results (more than ``most`` rows are refused); else JSON lines."""
    if not path.endswith(".json"):
        return write_jsonl(df, path)
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write JSON lines")
    return write_summary(rows, path)


def append_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_by_domain(df: DataFrame, path: str, column: str = "legal_domain", other: str = "general") -> None:
    """Files by domain; a missing one counts as ``other``. Every task writes its own rows' domains, so a hot one is spread as the input is."""
    df.withColumn(column, F.coalesce(column, F.lit(other))).write.mode("overwrite").partitionBy(column).parquet(path)


def write_summary(value: object, path: str) -> None:
    """A small JSON document, written beside and renamed."""
    beside = Path(f"{path}.tmp")
    beside.write_text(json.dumps(value, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
    os.replace(beside, path)


def copy_table(df: DataFrame, path: str) -> None:
    """A prior dataset passed through unchanged."""
    df.write.mode("overwrite").parquet(path)
