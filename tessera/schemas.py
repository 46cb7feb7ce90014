"""Record schemas (Spark DDL), and small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.fixed import CRITIQUE_DIMENSIONS, LEVELS

QA = "question STRING, candidate_answers ARRAY<STRING>, ground_truth STRING, legal_rationale STRING"
CRITIQUE = ", ".join(f"{d} DOUBLE" for d in CRITIQUE_DIMENSIONS) + ", issues STRING, suggestions STRING, all_pass BOOLEAN"
CHUNK = "chunk_id STRING, text STRING, source_doc STRING, source_path STRING, source_category STRING, legal_domain STRING, chunk_index INT, lang_confidence DOUBLE, content_hash STRING"
CONTEXT = "chunk_id STRING, text STRING, source_doc STRING"
PENDING = f"chunk_id STRING, context_text STRING, source_doc STRING, bloom STRING, qa STRUCT<{QA.replace(' STRING', ': STRING').replace(' ARRAY', ': ARRAY')}>"
QA_PAIR = f"{QA}, bloom_level STRING, qa_id STRING, chunk_id STRING, source_doc STRING, context_text STRING, refinement_loops INT, converged BOOLEAN"
TRACE = "qa_id STRING, bloom_level STRING, chunk_id STRING, total_loops INT, converged BOOLEAN"
RESULT = "model_name STRING, strategy STRING, bloom_level STRING, condition STRING, total_questions INT, correct INT, accuracy DOUBLE, sc_agreement_rate DOUBLE, predictions ARRAY<STRUCT<qa_id: STRING, predicted: STRING, ground_truth: STRING, correct: BOOLEAN>>"
QA_REQUIRED = ["question", "candidate_answers", "ground_truth", "bloom_level", "context_text"]


def levels(spark: SparkSession, names: list[str] = LEVELS) -> DataFrame:
    """(level, ordinal), ordinals from 1."""
    return spark.createDataFrame([(n, i) for i, n in enumerate(names, 1)], "level STRING, ordinal INT")


def missing_columns(df: DataFrame, required: list[str] = QA_REQUIRED) -> list[str]:
    """Required columns that the schema lacks: the whole table's, where a first record's were asked for."""
    return sorted(set(required) - set(df.columns))
