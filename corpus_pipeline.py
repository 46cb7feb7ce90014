"""From documents to packed training sequences: quality, exact copies, near copies, mixture, packing.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` applies them to the
documents, each stage's rows written as Parquet in the shared folder and read again as the next one's ``docs``. All stages
but the last return the columns of ``docs``. The mixture's order is that of the written files by name and of the rows in them;
Spark reads files by size, so packing takes its rows by file and place again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import in_file_order, materialise, table
from tessera.llm.exact_dedup import drop_exact_copies
from tessera.llm.mixing import mix_rows
from tessera.llm.near_duplicates import keep_one_of_each
from tessera.llm.packing import pack
from tessera.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the largest doc_id stays."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return keep_one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the mixture."""
    return mix_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens; tasks, and so sequence ids, rise with the order of the files."""
    return pack(in_file_order(docs.select("doc_id", "text")))


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("packing", packing)]

#: Tokens and learned scores are beyond SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
