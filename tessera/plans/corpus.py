"""Corpus plans: extraction of chunks from documents, preparation of a validated corpus, cleaning of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.functions import chunking, classify, quality
from tessera.operators import relational
from tessera.sources.writers import write_by_domain, write_jsonl


def present(df: DataFrame, *names: str, default: object = None) -> Column:
    """The first of ``names`` (dots for nested fields) that the schema has, null values included; else ``default``."""
    for name in names:
        schema = df.schema
        for part in name.split("."):
            if part not in getattr(schema, "names", ()):
                break
            schema = schema[part].dataType
        else:
            return F.col(name)
    return F.lit(default)


def extract_chunks(docs: DataFrame, label: Column | None = None, score: Column | None = None, target: str = "vi", **sizes: int) -> DataFrame:
    """Chunk records of ``docs`` (path, markdown): paragraphs filtered, chunked, numbered, then gated by language.

    Chunk numbers are given before the gate, so gated chunks leave gaps. ``label`` and ``score`` are the language model's
    columns over (chunk) ``text``; without them everything is kept with confidence 1.
    """
    name = F.element_at(F.split("path", "/"), -1)
    named = docs.select("path", name.alias("source_doc"), chunking.kept_paragraphs(F.col("markdown")).alias("kept"))
    made = chunking.chunk_documents(named, F.col("kept"), ["path", "source_doc"], **sizes)
    gate = quality.language_gate(F.col("text"), label, score, target)
    return made.withColumn("gate", gate).where("gate.keep").select(
        classify.chunk_id(F.col("source_doc"), F.col("chunk_index")).alias("chunk_id"), "text", "source_doc", F.col("path").alias("source_path"),
        classify.classify_source(F.col("path")).alias("source_category"), classify.classify_domain(F.col("source_doc")).alias("legal_domain"),
        F.col("chunk_index").cast("int").alias("chunk_index"), F.bround("gate.conf", 4).alias("lang_confidence"), classify.fingerprint(F.col("text")).alias("content_hash"),
    )


def valid_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where(quality.is_valid_chunk(F.col("chunk_id"), F.col("text"), F.col("source_doc")))


def prepare(chunks: DataFrame, path: str) -> dict:
    """Write the validated corpus (JSON lines, and by domain); return drop counts and length and source statistics."""
    label = F.when(F.char_length("text") < 100, F.lit("short")).otherwise(quality.disposition(F.col("text")))
    chunks.withColumn("__label", label).write.mode("overwrite").parquet(f"{path}/labelled")  # every rule runs once
    told = chunks.sparkSession.read.schema(StructType([*chunks.schema, StructField("__label", StringType())])).parquet(f"{path}/labelled")
    n = F.count_if(F.coalesce(F.col("__label") == F.lit("short"), F.lit(False)))
    dropped = told.agg(F.count("*").alias("total"), n.alias("short"), *(F.count_if(F.col("__label") == x).alias(x) for x in ("metadata", "ocr"))).first().asDict()
    kept = told.where((F.col("__label") == "kept") & quality.has_fields(F.col("chunk_id"), F.col("text"), F.col("source_doc"))).drop("__label")
    write_jsonl(kept, f"{path}/corpus")
    write_by_domain(kept, f"{path}/by_domain")
    lengths = relational.length_stats(kept, F.char_length("text")).first().asDict()
    sources = kept.agg(F.countDistinct(F.coalesce("source_doc", F.lit(""))).alias("n")).first()["n"]
    return {**dropped, "kept": lengths, "sources": sources}


def clean(records: DataFrame) -> DataFrame:
    """``records`` with a column ``disposition``: metadata, ocr, no_qa (where there is a qa field that is null) or kept."""
    context = present(records, "context_text", "text", default="")
    qa = F.col("qa").isNotNull() if "qa" in records.columns else None
    return records.withColumn("disposition", quality.disposition(F.coalesce(context, F.lit("")), qa))


def contexts(records: DataFrame, seq: str = "seq", limit: int | None = None) -> DataFrame:
    """(chunk_id, text, source_doc, seq): the first record of each chunk id (qa_id where there is none), in order."""
    ident = present(records, "chunk_id", "qa_id", default="").cast("string")
    named = records.select(ident.alias("chunk_id"), present(records, "context_text", "context_payload.text", "text").alias("text"), present(records, "source_doc", default="").alias("source_doc"), seq)
    return relational.first_n(relational.keep_first(named, F.col("chunk_id"), F.col(seq)), limit, seq)
