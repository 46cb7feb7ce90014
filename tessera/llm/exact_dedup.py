"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own bytes say so (a rule on the last bytes of four characters, with a least and a most chunk length), so
equal stretches of two texts give equal chunks wherever they stand, in any script. Each chunk has a 64-bit identifier.
Identifiers are *verified*: every distinct (identifier, chunk) pair meets its namesakes once, and an identifier that names two
different chunks is widened by the chunk's SHA-256. A document is then its recipe, the ordered list of identifiers, and equal
recipes are equal texts. The texts move through one shuffle, as distinct chunks after map-side combination; every later
step moves recipes only.

Scale: the chunk shuffle is spread by (identifier, chunk), so no hot text lands in one task; groups are pre-aggregated on
the map side; the join that hands each row its group is an equi-join whose hot keys adaptive execution splits. Clashing
identifiers (a few per 10^10 chunks) are joined like any table, and only where there are some.

Cases: null text counts as empty; all empty texts are equal (recipe ``[]``). Texts are equal when identical after
lower-casing A-Z only. Of equal texts the row with the largest doc_id stays; null ids rank lowest, and among repeated rows
of one id exactly one stays. An empty table gives no rows. Extra columns are ignored and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, fresh, materialise, table, text_of, without



def _character(r: int, of: int) -> str:
    """A character of UTF-8 whose last byte leaves ``r`` when divided by ``of``."""
    one, last = ("".join(f"\\x{b:02x}" for b in some if b % of == r) for some in (range(0x80), range(0x80, 0xC0)))
    return rf"(?:[{one}]|[\xc0-\xff][\x80-\xbf]{{0,2}}[{last}])"


#: A cut falls after four characters of these residues: in text of any script after one in some hundreds.
CUT = "".join(_character(r, of) for r, of in ((1, 4), (2, 4), (0, 4), (2, 3)))


def chunks(text: Column, least: int = 512, most: int = 8192, cut: str = CUT) -> Column:
    """Content-defined chunks of a text, as bytes; joined in order they are the text."""
    pattern = rf"(?s).{{{least - 4},{most - 16}}}?{cut}|.{{1,{most}}}"  # four characters are at most 16 bytes
    shown = F.decode(text.cast("binary"), "ISO-8859-1")  # a character a byte, so that the rule sees bytes
    return F.transform(F.regexp_extract_all(shown, F.lit(pattern), F.lit(0)), lambda c: F.encode(c, "ISO-8859-1"))


def _collisions(pieces: DataFrame) -> DataFrame:
    """Identifiers that name more than one chunk: (h). ``pieces`` has (h, chunk)."""
    return pieces.groupBy("h", "chunk").agg(F.lit(1).alias("one")).groupBy("h").agg(F.sum("one").alias("n")).where("n > 1").select("h")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 512, most: int = 8192, identifier=F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``identifier`` maps a chunk column to its 64-bit identifier (a weak one serves to test verification).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(text_of(text_col)).alias("t"))
    pieces = rows.select(F.explode(chunks(F.col("t"), least, most)).alias("chunk")).select(identifier("chunk").alias("h"), "chunk")
    clash = materialise(_collisions(pieces), "clash")
    rid, recipe = F.monotonically_increasing_id().alias("rid"), F.transform(chunks(F.col("t"), least, most), lambda c: identifier(c))
    if clash.limit(1).count():
        rows = materialise(rows.select("*", rid), "rows")
        each = rows.select("rid", F.posexplode(chunks(F.col("t"), least, most)).alias("at", "chunk")).withColumn("name", identifier("chunk"))
        each = each.join(clash, each["name"] == clash["h"], "left")
        name = F.when(F.col("h").isNull(), F.col("name").cast("string")).otherwise(F.sha2("chunk", 256))
        recipes = each.groupBy("rid").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", name.alias("name")))), lambda x: x["name"]).alias("recipe"))  # chunks of one text
        rows = rows.join(recipes, "rid", "left")
        rid, recipe = F.col("rid"), F.coalesce("recipe", F.array().cast("array<string>"))
    base = materialise(rows.select("doc_id", rid, recipe.alias("recipe"), F.sha2(F.col("t"), 256).alias("text_sha256")), "recipes")
    groups = base.groupBy("recipe").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("group_size"))
    # Written, so that the join is of two plain exchanges, whose hot keys are split.
    several = materialise(groups.where("group_size > 1"), "copies")
    alone = F.col("keep").isNull()
    return base.join(several, "recipe", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("rid") == F.col("keep.rid"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that exact deduplication drops; same columns."""
    key = fresh(docs, "text_sha256")
    seen = materialise(exact_dedup(docs).select("doc_id", F.col("text_sha256").alias(key), "kept"), "decisions")
    return without(docs.withColumn(key, F.sha2(ascii_lower(text_of()), 256)), seen, key).drop(key)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
"""
