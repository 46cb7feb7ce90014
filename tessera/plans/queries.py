"""Named queries over the tables, each beside the DuckDB SQL that gives the same rows.

The tables hold no question-answer data, so stand-ins are explicit: a document's lines are its paragraphs, a user's events
are votes, a conversation is a refinement trace. Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import chunking, classify, parse, quality
from tessera.functions.fixed import CRITIQUE_DIMENSIONS, LEVELS
from tessera.functions.text import BREAKS
from tessera.operators import evaluate, prompts, refine, relational, stats
from tessera.plans import experiments
from tessera.schemas import levels
from tessera.session import run_folder
from tessera.sources import manifest, readers
from tessera.sources.writers import write_by_domain, write_jsonl

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")




def text() -> Column:
    return F.col("text")


def spaced_lines() -> Column:
    """Lines as paragraphs, whatever ends them."""
    return F.regexp_replace(text(), f"[{BREAKS}]", "\n\n")



# --- SQL pieces ---
_ENDS = r"""[.,;:"()\[\]{}<>!?''\-]"""
_TOKENS = r"list_filter(string_split_regex(text, '\s+'), lambda t: t <> '')"
_BARE = rf"list_transform({_TOKENS}, lambda t: regexp_replace(t, '^{_ENDS}+|{_ENDS}+$', '', 'g'))"
_BAD = (
    rf"len(list_filter({_BARE}, lambda t: t <> '' AND NOT regexp_matches(t, '[/_-]') AND NOT (upper(t) = t AND lower(t) <> t) AND ("
    r"(length(t) >= 3 AND regexp_matches(t, '\p{Ll}') AND regexp_matches(t, '\p{Nd}')) OR (regexp_matches(t, '[;:!<>*&^%$#@~=+|\\]') AND regexp_matches(t, '\pL')))))"
)
_OCR = rf"(len({_TOKENS}) = 0 OR 20 * {_BAD} > len({_TOKENS}))"
_ROWS = r"list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


def _metadata_sql(keywords: list[str], upper_keywords: bool = True, min_body: int | None = 80) -> str:
    hits = " + ".join("contains(upper(text), '{}')::INT".format(k.upper() if upper_keywords else k) for k in keywords)
    body = f" OR length(array_to_string(list_filter({_ROWS}, lambda x: NOT starts_with(x, '#')), ' ')) < {min_body}" if min_body is not None else ""
    return f"(len({_ROWS}) = 0 OR 10 * len(list_filter({_ROWS}, lambda x: starts_with(x, '#'))) > 6 * len({_ROWS}) OR {hits} >= 2{body})"


_META = _metadata_sql(quality.PREPARE_KEYWORDS)
_LETTERS = "[^\\pL\\pN_]"

# --- text quality ---


@query(f"""
WITH d AS (SELECT lang, CASE WHEN {_META} THEN 'metadata' WHEN {_OCR} THEN 'ocr' ELSE 'kept' END AS disposition FROM documents)
SELECT lang, disposition, count(*) AS n FROM d GROUP BY ALL""")
def q01_doc_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("lang", quality.disposition(text()).alias("disposition"))
    return docs.groupBy("lang", "disposition").agg(F.count("*").alias("n"))


@query(f"""
SELECT count(*) AS total, count(*) FILTER (length(text) < 100) AS short, count(*) FILTER (length(text) >= 100 AND {_META}) AS metadata,
       count(*) FILTER (length(text) >= 100 AND NOT {_META} AND {_OCR}) AS ocr FROM documents""")
def q02_drop_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.drop_accounting(read(spark, sf_dir, "documents"), text(), quality.is_metadata(text()), quality.is_bad_ocr(text()))


@query(f"SELECT doc_id, {_BAD} AS bad, len({_TOKENS}) AS total FROM documents")
def q03_bad_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", quality.token_counts(text()).alias("t")).selectExpr("doc_id", "CAST(t.bad AS LONG) AS bad", "CAST(t.total AS LONG) AS total")


#: Stand-in keywords that the tables hold.
_WORDS = ["UND", "Sich", "QUE", "Mit", "OUAN", "ERTH"]


@query(f"SELECT doc_id, {_metadata_sql(_WORDS, False, None)} AS metadata FROM documents")
def q04_metadata_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", quality.is_metadata(text(), _WORDS, upper_keywords=False, min_body=None).alias("metadata"))


@query(f"SELECT doc_id, {_metadata_sql(_WORDS)} AS metadata FROM documents")
def q04_metadata_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", quality.is_metadata(text(), _WORDS).alias("metadata"))


@query(f"SELECT doc_id FROM documents WHERE source <> '' AND text <> '' AND length(text) >= 100 AND NOT {_META} AND NOT {_OCR}")
def q05_valid_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.where(quality.is_valid_chunk(F.col("doc_id"), text(), F.col("source"))).select("doc_id")


@query("SELECT lang AS value, count(*) AS n, min(doc_id) AS first_seq FROM documents GROUP BY lang")
def q06_frequency_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.frequency(read(spark, sf_dir, "documents"), F.col("lang"), F.col("doc_id"))


@query("SELECT source AS value, count(*) AS n, min(doc_id) AS first_seq FROM documents GROUP BY source")
def q06_frequency_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.frequency(read(spark, sf_dir, "documents"), F.col("source"), F.col("doc_id"))


@query("SELECT count(*) AS n, min(length(text)) AS shortest, round(avg(length(text)), 6) AS mean, max(length(text)) AS longest, count(DISTINCT coalesce(source, '')) AS sources FROM documents")
def q07_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.char_length(text()).cast("long").alias("len"), F.coalesce("source", F.lit("")).alias("source"))
    one = relational.length_stats(docs, F.col("len")).withColumn("mean", F.round("mean", 6))
    return one.crossJoin(docs.agg(F.countDistinct("source").alias("sources")))  # one row each


@query(f"""
SELECT doc_id, md5(coalesce(string_agg(p, chr(10) || chr(10) ORDER BY i), '')) AS text_md5 FROM (
  SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM (
    SELECT doc_id, list_filter({_ROWS}, lambda p: p <> '') AS ps FROM documents))
CROSS JOIN LATERAL (SELECT p AS text) AS t
WHERE NOT {_metadata_sql(quality.EXTRACT_KEYWORDS, False, None)} AND NOT {_OCR}
GROUP BY doc_id HAVING length(coalesce(string_agg(p, chr(10) || chr(10) ORDER BY i), '')) >= 200""")
def q08_kept_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", chunking.kept_paragraphs(spaced_lines()).alias("t"))
    return docs.where(F.char_length("t") >= 200).select("doc_id", F.md5("t").alias("text_md5"))


# --- chunking ---


def _chunks_sql(edge: str, select: str) -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_ROWS} AS ps, text FROM documents),
long AS (SELECT * FROM d WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 200),
p AS (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM long),
q AS (SELECT doc_id, i, length(p) AS len, {edge} AS edge FROM p),
r AS (
  SELECT doc_id, -1::BIGINT AS i, 0::BIGINT AS pos, 0::BIGINT AS cnt, 0::BIGINT AS n, 0::BIGINT AS off, 0::BIGINT AS prev, CAST([] AS STRUCT(pos BIGINT, cnt BIGINT, s BIGINT, e BIGINT)[]) AS outs FROM long
  UNION ALL
  SELECT doc_id, i, CASE WHEN done THEN pos + cnt - 1 ELSE pos END, CASE WHEN done THEN 1 ELSE cnt END, CASE WHEN done THEN len ELSE n END, off, len,
         CASE WHEN done AND n + 2 * (cnt - 1) >= 200 THEN list_append(outs, {{'pos': pos, 'cnt': cnt, 's': off - n, 'e': off}}) ELSE outs END
  FROM (
    SELECT *, n >= 1500 AND NOT edge AS done FROM (
      SELECT doc_id, i, len, edge, CASE WHEN fill THEN pos + cnt - 1 ELSE pos END AS pos, CASE WHEN fill THEN 2 ELSE cnt + 1 END AS cnt,
             CASE WHEN fill THEN prev ELSE n END + len AS n, off + len + 2 AS off,
             CASE WHEN fill AND n + 2 * (cnt - 1) >= 200 THEN list_append(outs, {{'pos': pos, 'cnt': cnt, 's': off - n, 'e': off}}) ELSE outs END AS outs
      FROM (
        SELECT *, n + len > 5000 AND cnt > 0 AS fill FROM (
          SELECT r.doc_id, q.i, q.len, q.edge, r.prev, r.off, CASE WHEN cut THEN r.pos + r.cnt ELSE r.pos END AS pos, CASE WHEN cut THEN 0 ELSE r.cnt END AS cnt, CASE WHEN cut THEN 0 ELSE r.n END AS n,
                 CASE WHEN cut AND r.cnt > 0 AND r.n + 2 * (r.cnt - 1) >= 200 THEN list_append(r.outs, {{'pos': r.pos, 'cnt': r.cnt, 's': r.off - r.n, 'e': r.off}}) ELSE r.outs END AS outs
          FROM r JOIN q ON q.doc_id = r.doc_id AND q.i = r.i + 1, LATERAL (SELECT q.edge AND r.n > 200 AS cut)))))
),
f AS (
  SELECT r.doc_id, CASE WHEN cnt > 0 AND n + 2 * (cnt - 1) >= 200 THEN list_append(outs, {{'pos': pos, 'cnt': cnt, 's': off - n, 'e': off}}) ELSE outs END AS outs
  FROM r JOIN long ON r.doc_id = long.doc_id AND r.i = len(long.ps) - 1
),
u AS (SELECT doc_id, unnest(outs) AS o, unnest(range(len(outs))) AS chunk_index FROM f),
c AS (
  SELECT u.doc_id, long.lang, CAST(chunk_index AS INTEGER) AS chunk_index, array_to_string(long.ps[o.pos + 1:o.pos + o.cnt], chr(10) || chr(10)) AS t, CAST(o.s AS INTEGER) AS start_char, CAST(o.e AS INTEGER) AS end_char
  FROM u JOIN long ON u.doc_id = long.doc_id
)
{select}"""


_CHUNK_ROWS = "SELECT doc_id, chunk_index, 'doc_' || doc_id || '_chunk_' || lpad(CAST(chunk_index AS VARCHAR), 4, '0') AS chunk_id, length(t) AS n, substr(md5(t), 1, 12) AS content_hash, start_char, end_char FROM c"


def _chunk_rows(docs: DataFrame, boundary: str) -> DataFrame:
    made = chunking.chunk_documents(docs, spaced_lines(), ["doc_id"], boundary=boundary, whole=text())
    name = F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return made.select("doc_id", "chunk_index", classify.chunk_id(name, F.col("chunk_index")).alias("chunk_id"), F.char_length("text").cast("long").alias("n"), classify.fingerprint(text()).alias("content_hash"), "start_char", "end_char")


@query(_chunks_sql("false", _CHUNK_ROWS))
def q09_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(read(spark, sf_dir, "documents"), chunking.SECTION)


#: A stand-in section start that the tables hold.
_EDGE = r"\A(?:The|Thin|Die|En|Les|Los|De|In|An) "


@query(_chunks_sql("regexp_matches(p, '^(?:The|Thin|Die|En|Les|Los|De|In|An) ')", _CHUNK_ROWS))
def q10_chunks_with_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(read(spark, sf_dir, "documents"), _EDGE)


@query(_chunks_sql("false", "SELECT lang, count(*) AS n, min(length(t)) AS shortest, round(avg(length(t)), 6) AS mean, max(length(t)) AS longest FROM c GROUP BY lang"))
def q11_chunk_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.chunk_documents(read(spark, sf_dir, "documents"), spaced_lines(), ["doc_id", "lang"], whole=text())
    return relational.length_stats(made, F.char_length("text").cast("long"), ["lang"]).withColumn("mean", F.round("mean", 6))


@query("SELECT doc_id AS id, substr(md5(text), 1, 12) AS content_hash FROM documents UNION ALL SELECT conv_id * 1000 + turn, substr(md5(text), 1, 12) FROM conversations")
def q12_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), classify.fingerprint(text()).alias("content_hash"))
    turns = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), classify.fingerprint(text()).alias("content_hash"))
    return docs.union(turns)


@query("SELECT doc_id, h AS content_hash FROM (SELECT doc_id, substr(md5(text), 1, 12) AS h, row_number() OVER (PARTITION BY substr(md5(text), 1, 12) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def q13_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", classify.fingerprint(text()).alias("content_hash"))
    return relational.keep_first(docs, F.col("content_hash"), F.col("doc_id"))


_LEVEL_ROWS = ", ".join(f"('{n}', {i})" for i, n in enumerate(LEVELS, 1))


@query(f"""
SELECT CAST(d.doc_id AS VARCHAR) AS chunk_id, l.level, l.ordinal FROM documents d CROSS JOIN (VALUES {_LEVEL_ROWS}) AS l(level, ordinal)
WHERE NOT EXISTS (SELECT 1 FROM labels x WHERE x.doc_id = d.doc_id AND x.doc_id % 6 + 1 = l.ordinal)""")
def q14_jobs_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(n) for n in LEVELS))
    contexts = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"))
    done = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("chunk_id"), F.element_at(names, (F.col("doc_id") % 6 + 1).cast("int")).alias("level"))
    return relational.jobs(contexts, levels(spark), done)


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def q15_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.first_n(read(spark, sf_dir, "documents").select("doc_id", "source"), 100, "doc_id")


_URL_GROUPS = [("hinh_su", ["a1", "b2"]), ("hanh_chinh", ["3", "c4"]), ("dan_su", ["5", "7"])]


def _first_of_sql(c: str, groups: list[tuple[str, list[str]]], other: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'''contains({c}, '{w}')''' for w in ws)} THEN '{g}'" for g, ws in groups)
    return f"CASE {cases} ELSE '{other}' END"


@query(f"SELECT page_id, {_first_of_sql('lower(url)', _URL_GROUPS, 'general')} AS domain, {_first_of_sql('url', [('site', ['example']), ('other_site', ['www'])], 'unknown')} AS category FROM pages")
def q16_classify_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", classify.classify_domain(url, _URL_GROUPS).alias("domain"), classify.classify_source(url, [("site", ["example"]), ("other_site", ["www"])]).alias("category"))


_PHRASES = [("Create", ["erth in", "de la"]), ("Evaluate", [r"(?:the|die) (?:an|er)", "ÉAU Q"]), ("Analyze", [r"(?:of|und) [^\n]*?the (?:in|an)"]), ("Apply", ["ción", "sch"])]


@query(
    "SELECT conv_id, turn, CASE "
    + " ".join("WHEN regexp_matches(text, '{}', 'i') THEN '{}'".format("|".join(p.replace(" ", r"\s+") for p in ps), g) for g, ps in _PHRASES)
    + " ELSE 'Remember' END AS level FROM conversations WHERE role = 'user'"
)
def q17_classify_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", classify.classify_patterns(text(), _PHRASES).alias("level"))


@query("""
SELECT doc_id, CASE WHEN length(trim(replace(text, chr(10), ' '))) < 20 THEN true WHEN lang = 'en' THEN (doc_id % 10) / 10.0 >= 0.5 ELSE false END AS keep,
       CAST(CASE WHEN length(trim(replace(text, chr(10), ' '))) < 20 THEN 1.0 WHEN lang = 'en' THEN (doc_id % 10) / 10.0 ELSE 0.0 END AS DOUBLE) AS conf FROM documents""")
def q18_language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = quality.language_gate(text(), F.col("lang"), (F.col("doc_id") % 10) / F.lit(10.0), "en")
    return read(spark, sf_dir, "documents").select("doc_id", gate.alias("g")).select("doc_id", "g.keep", "g.conf")


# --- answers, votes, cells ---

_ANSWER = "concat('(', chr(CAST(65 + event_id % 5 AS INTEGER)), ') ', event_type)"


@query(f"""
SELECT event_id, nullif(regexp_extract(substr({_ANSWER}, 1, 10), '(?:^|{_LETTERS})([A-D])(?:$|{_LETTERS})', 1), '') AS answer,
       nullif(regexp_extract(substr({_ANSWER}, 1, 5), '(?:^|{_LETTERS})([A-D])(?:$|{_LETTERS})', 1), '') AS truth FROM events""")
def q19_answer_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("("), F.chr((F.lit(65) + F.col("event_id") % 5).cast("int")), F.lit(") "), F.col("event_type"))
    events = read(spark, sf_dir, "events").select("event_id", made.alias("t"))
    return events.select("event_id", parse.extract_answer(F.col("t"), "standard").alias("answer"), parse.truth_letter(F.col("t")).alias("truth"))


@query(rf"""
SELECT doc_id, nullif(regexp_extract(regexp_extract_all(regexp_replace(text, '({_LETTERS})', '\1\1', 'g'), '(?:^|{_LETTERS})[A-D](?:$|{_LETTERS})')[-1], '[A-D]'), '') AS answer FROM documents""")
def q20_answer_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", parse.extract_answer(text(), "cot").alias("answer"))


@query("""
WITH v AS (SELECT user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS vote, event_id FROM events),
c AS (SELECT user_id, vote, count(*) AS n, min(event_id) AS f FROM v WHERE vote IS NOT NULL GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r, sum(n) OVER (PARTITION BY user_id) AS total FROM c)
SELECT u.user_id, w.vote AS winner, coalesce(round(w.n / w.total, 9), 0.0) AS agreement, CAST(coalesce(w.total, 0) AS BIGINT) AS n_valid
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN w ON u.user_id = w.user_id AND w.r = 1""")
def q21_majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    vote = F.when(F.col("event_id") % 7 != 0, F.col("event_type"))
    return evaluate.majority_vote(read(spark, sf_dir, "events"), ["user_id"], vote, F.col("event_id")).withColumn("agreement", F.round("agreement", 9))


def _cell_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.element_at(F.array(*(F.lit(n) for n in LEVELS)), (F.col("user_id") % 6 + 1).cast("int"))
    strategy = F.element_at(F.array(*(F.lit(n) for n in ("standard", "few_shot", "cot", "self_consistency"))), (F.col("event_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "events").select(level.alias("level"), strategy.alias("strategy"), (F.col("event_id") % 3).alias("model"), (F.col("value") > 50).alias("correct"))


_CELL_ROWS = f"SELECT [{', '.join(repr(n) for n in LEVELS)}][user_id % 6 + 1] AS level, ['standard', 'few_shot', 'cot', 'self_consistency'][event_id % 4 + 1] AS strategy, event_id % 3 AS model, value > 50 AS correct FROM events"


@query(f"SELECT level, strategy, count(*) AS total_questions, count(*) FILTER (correct) AS correct, round(count(*) FILTER (correct) / count(*), 9) AS accuracy FROM ({_CELL_ROWS}) GROUP BY ALL")
def q22_accuracy_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy_cells(_cell_rows(spark, sf_dir), ["level", "strategy"]).withColumn("accuracy", F.round("accuracy", 9))


_MODEL_CELLS = f"SELECT level, strategy, model, count(*) FILTER (correct) / count(*) AS accuracy FROM ({_CELL_ROWS}) GROUP BY ALL"
_PIVOT = ", ".join(f"round(max(accuracy) FILTER (strategy = '{s}'), 9) AS {s}" for s in ("standard", "few_shot", "cot", "self_consistency"))


@query(f"SELECT level, {_PIVOT} FROM (SELECT level, strategy, arg_max(accuracy, model) AS accuracy FROM ({_MODEL_CELLS}) GROUP BY ALL) GROUP BY level")
def q23_accuracy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = evaluate.accuracy_cells(_cell_rows(spark, sf_dir), ["level", "strategy", "model"])
    matrix = evaluate.accuracy_matrix(cells, F.col("model"))
    return matrix.select("level", *(F.round(s, 9).alias(s) for s in matrix.columns[1:]))


@query(f"""
SELECT g.level, l.ordinal, round(coalesce(g.cot, 0) - coalesce(g.standard, 0), 9) AS gap FROM (
  SELECT level, max(a) FILTER (strategy = 'cot') AS cot, max(a) FILTER (strategy = 'standard') AS standard
  FROM (SELECT level, strategy, count(*) FILTER (correct) / count(*) AS a FROM ({_CELL_ROWS}) GROUP BY ALL) GROUP BY level) g
JOIN (VALUES {_LEVEL_ROWS}) AS l(level, ordinal) ON g.level = l.level""")
def q24_depth_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = evaluate.accuracy_cells(_cell_rows(spark, sf_dir), ["level", "strategy"]).withColumn("seq", F.lit(0))
    return evaluate.depth_gap(evaluate.accuracy_matrix(cells, F.col("seq")), levels(spark)).withColumn("gap", F.round("gap", 9))


_ANOVA_CELLS = "SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity) * count(*), 2) AS m2 FROM lineitem GROUP BY ALL"


@query(_ANOVA_CELLS)
def q25_anova_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = stats.anova_cells(read(spark, sf_dir, "lineitem"), F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity"))
    return cells.withColumn("mean", F.round("mean", 6)).withColumn("m2", F.round("m2", 2))


# Sequential sums of squares over balanced cell tables: with b's share the same in every a, type II sums are those of the
# margins. The SQL solves the additive fit by least squares over the cells (a few backfitting rounds reach it).
_FIT = "WITH RECURSIVE rows AS ({rows}), c AS (SELECT a, b, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS w FROM rows GROUP BY a, b), g AS (SELECT avg(y) AS m, var_pop(y) * count(*) AS total FROM rows),"
_ANOVA_SQL = _FIT + """
f AS (
  SELECT 0 AS k, a, b, n, m, w, (SELECT m FROM g) AS ea, 0.0::DOUBLE AS eb FROM c
  UNION ALL
  SELECT k + 1, a, b, n, m, w, ea, sum(n * (m - ea)) OVER (PARTITION BY b) / sum(n) OVER (PARTITION BY b) AS eb
  FROM (SELECT k, a, b, n, m, w, eb, sum(n * (m - eb)) OVER (PARTITION BY a) / sum(n) OVER (PARTITION BY a) AS ea FROM f WHERE k < 60)
),
s AS (
  SELECT sum(w) AS within, sum(w) + sum(n * pow(m - ea - eb, 2)) AS rss_ab, sum(n) - count(*) AS rest, count(DISTINCT a) AS na, count(DISTINCT b) AS nb,
         (SELECT sum(w) + sum(n * pow(m - x, 2)) FROM (SELECT *, sum(n * m) OVER (PARTITION BY a) / sum(n) OVER (PARTITION BY a) AS x FROM c)) AS rss_a,
         (SELECT sum(w) + sum(n * pow(m - x, 2)) FROM (SELECT *, sum(n * m) OVER (PARTITION BY b) / sum(n) OVER (PARTITION BY b) AS x FROM c)) AS rss_b
  FROM f WHERE k = 60
),
e AS (
  SELECT 'a' AS effect, rss_b - rss_ab AS ss, na - 1 AS df, * EXCLUDE (rss_a, rss_b, rss_ab) FROM s UNION ALL SELECT 'b', rss_a - rss_ab, nb - 1, * EXCLUDE (rss_a, rss_b, rss_ab) FROM s
  UNION ALL SELECT 'a:b', rss_ab - within, (na - 1) * (nb - 1), * EXCLUDE (rss_a, rss_b, rss_ab) FROM s UNION ALL SELECT 'residual', within, rest, * EXCLUDE (rss_a, rss_b, rss_ab) FROM s
)
SELECT effect, round(ss, 5) AS ss, CAST(df AS INTEGER) AS df, CASE WHEN effect <> 'residual' THEN round((ss / df) / (within / rest), 5) END AS f,
       CASE WHEN effect <> 'residual' THEN round(ss / sum(ss) OVER (), 8) END AS eta_sq FROM e"""


@query(_ANOVA_SQL.format(rows=f"SELECT level AS a, strategy AS b, correct::INT AS y FROM ({_CELL_ROWS})"))
def q25_anova_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stats.anova_two_way(stats.anova_cells(_cell_rows(spark, sf_dir), F.col("level"), F.col("strategy"), F.col("correct").cast("int")))
    rounded = lambda v, n: None if v is None else round(float(v), n)
    rows = [(k, rounded(table[k]["ss"], 5), int(table[k]["df"]), rounded(table[k].get("F"), 5), rounded(table[k].get("eta_sq"), 8)) for k in ("a", "b", "a:b", "residual")] if "error" not in table else []
    return spark.createDataFrame(rows, "effect STRING, ss DOUBLE, df INT, f DOUBLE, eta_sq DOUBLE")


_TRACES = f"SELECT conv_id, [{', '.join(repr(n) for n in LEVELS)}][conv_id % 6 + 1] AS level, count(*) AS loops, arg_max(role, turn) = 'assistant' AS converged FROM conversations GROUP BY conv_id"
_REFINED = f"SELECT t.level, l.ordinal, count(*) AS n, avg(loops) AS mean_loops, median(loops) AS median_loops, max(loops) AS max_loops, count(*) FILTER (converged) / count(*) AS convergence_rate FROM ({_TRACES}) t JOIN (VALUES {_LEVEL_ROWS}) AS l(level, ordinal) ON t.level = l.level GROUP BY t.level, l.ordinal"


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.element_at(F.array(*(F.lit(n) for n in LEVELS)), (F.col("conv_id") % 6 + 1).cast("int"))
    made = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("loops"), (F.max_by("role", "turn") == "assistant").alias("converged"))
    return made.select("conv_id", level.alias("level"), "loops", "converged")


@query(f"SELECT level, ordinal, n, round(mean_loops, 9) AS mean_loops, median_loops, max_loops, round(convergence_rate, 9) AS convergence_rate FROM ({_REFINED})")
def q26_refinement_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.refinement_stats(_traces(spark, sf_dir), levels(spark))
    return found.withColumn("mean_loops", F.round("mean_loops", 9)).withColumn("convergence_rate", F.round("convergence_rate", 9))


@query(f"""
WITH r AS (SELECT ordinal::DOUBLE AS a, rank() OVER (ORDER BY mean_loops) + (count(*) OVER (PARTITION BY mean_loops) - 1) / 2.0 AS b FROM ({_REFINED}))
SELECT round(corr(a, b), 9) AS rho, CAST(count(*) AS INTEGER) AS n FROM r""")
def q27_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.refinement_stats(_traces(spark, sf_dir), levels(spark)).select("ordinal", "mean_loops")
    one = stats.spearman(found, "ordinal", "mean_loops")
    return spark.createDataFrame([(round(one["rho"], 9) if one["rho"] is not None else None, found.count())], "rho DOUBLE, n INT")


# --- loops and prompts ---


@query("""
WITH p AS (SELECT doc_id, k, (doc_id * 31 + k * k * 7 + doc_id % 5 * k) % 5 AS v FROM documents CROSS JOIN range(10) AS r(k)),
c AS (SELECT doc_id, v, count(*) AS n, min(k) AS f FROM p WHERE v < 4 GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS r, sum(n) OVER (PARTITION BY doc_id) AS t FROM c)
SELECT d.doc_id, chr(CAST(65 + v AS INTEGER)) AS winner, coalesce(round(n / t, 9), 0.0) AS agreement, CAST(coalesce(t, 0) AS BIGINT) AS n_valid FROM documents d LEFT JOIN w ON d.doc_id = w.doc_id AND r = 1""")
def q28_self_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = read(spark, sf_dir, "documents").select("doc_id").crossJoin(F.broadcast(spark.range(10).withColumnRenamed("id", "k")))
    v = (F.col("doc_id") * 31 + F.col("k") * F.col("k") * 7 + F.col("doc_id") % 5 * F.col("k")) % 5
    answered = paths.withColumn("text", F.concat(F.lit("so the answer is "), F.chr((F.lit(65) + v).cast("int"))))
    votes = evaluate.majority_vote(answered, ["doc_id"], parse.extract_answer(text(), "self_consistency"), F.col("k"))
    return votes.withColumn("agreement", F.round("agreement", 9))


_OUTCOME = f"""
WITH j AS (SELECT doc_id, ordinal, level, [(doc_id * 7 + ordinal + loop) % 4 = 0 FOR loop IN [1, 2, 3]] AS ok FROM documents CROSS JOIN (VALUES {_LEVEL_ROWS}) AS l(level, ordinal))
SELECT doc_id, level, CASE WHEN ok[1] THEN 1 WHEN ok[2] THEN 2 ELSE 3 END AS refinement_loops, ok[1] OR ok[2] OR ok[3] AS converged FROM j"""


def _refining(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Callable, Callable, Callable]:
    """Jobs, and stand-ins for generator, critic and refiner: the question tells its loop, and a rule on ids which loop passes."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("source_doc"), F.lit("").alias("text"))
    loop = F.regexp_extract("qa.question", r"(\d+)", 1).cast("int")

    def pair(n: Column) -> Column:
        return F.concat(F.lit("<qa_pair><question>loop "), n.cast("string"), F.lit("</question><candidate_answers>A. a\nB. b</candidate_answers><ground_truth>A</ground_truth><legal_rationale>r</legal_rationale></qa_pair>"))

    def critic(df: DataFrame) -> DataFrame:
        passed = (F.col("chunk_id").cast("long") * 7 + F.col("ordinal") + loop) % 4 == 0
        return df.withColumn("output", F.concat(*(F.concat(F.lit(f"<{d}>"), F.when(passed, "1").otherwise("0"), F.lit(f"</{d}>")) for d in CRITIQUE_DIMENSIONS)))

    return relational.jobs(docs, levels(spark)), lambda df: df.withColumn("output", pair(F.lit(1))), critic, lambda df: df.withColumn("output", pair(loop + 1))


@query(_OUTCOME)
def q29_refine_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = refine.refine_in_passes(*_refining(spark, sf_dir), run_folder(spark, "refine"))
    return pairs.select(F.col("chunk_id").cast("long").alias("doc_id"), F.col("bloom_level").alias("level"), "refinement_loops", "converged")


@query(f"""
WITH o AS ({_OUTCOME.strip()})
SELECT 'adaptive' AS mode, * FROM o UNION ALL SELECT m.mode, o.doc_id, o.level, m.loops, m.loops = 0 FROM o CROSS JOIN (VALUES ('single_pass', 0), ('fixed_2', 2), ('fixed_3', 3)) AS m(mode, loops)""")
def q29_refine_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, steps = None, _refining(spark, sf_dir)
    for mode in ("adaptive", "single_pass", "fixed_2", "fixed_3"):
        pairs, _ = refine.refine_traced(*steps, run_folder(spark, mode), mode)
        one = pairs.select(F.lit(mode).alias("mode"), F.col("chunk_id").cast("long").alias("doc_id"), F.col("bloom_level").alias("level"), "refinement_loops", "converged")
        every = one if every is None else every.unionByName(one)
    return every


_QA_XML = "concat('<QA_pair><question> Q', conv_id, ' </question><candidate_answers>\nA. ', role, '\n\nB) two', CASE WHEN turn % 3 = 0 THEN '\nnote' ELSE '' END, '\n</candidate_answers><ground_truth>A</ground_truth>', CASE WHEN turn % 4 = 3 THEN '' ELSE '<legal_rationale> r </legal_rationale>' END, '</qa_pair>')"


@query("""
SELECT conv_id, turn, 'Q' || conv_id AS question, 'A. ' || role || '|B) two' AS candidates, 'A' AS ground_truth, 'r' AS legal_rationale FROM conversations WHERE turn % 4 <> 3""")
def q30_qa_xml_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(parse.parse_qa(F.expr(_QA_XML))).alias("qa"))
    return turns.select("conv_id", "turn", "qa.question", F.array_join("qa.candidate_answers", "|").alias("candidates"), "qa.ground_truth", "qa.legal_rationale")


def _critique_xml(concat_null: str = "") -> Column:
    dims = [F.concat(F.lit(f"<{d.upper()}>\n"), F.when(F.col("doc_id") % (i + 2) == 0, F.lit("10")).otherwise(F.col("quality").cast("string")), F.lit(f"</{d}>")) for i, d in enumerate(CRITIQUE_DIMENSIONS[:4])]
    last = F.when(F.col("doc_id") % 11 != 0, F.concat(F.lit(f"<{CRITIQUE_DIMENSIONS[4]}>"), F.col("toxic").cast("string"), F.lit(f"</{CRITIQUE_DIMENSIONS[4]}>"))).otherwise(F.lit(concat_null))
    return F.concat(*dims, last, F.lit("<issues> some </issues>"))


_DIM_SQL = [f"CASE WHEN doc_id % {i + 2} = 0 OR quality = 1 THEN 1 ELSE 0 END" for i in range(4)] + ["toxic"]


@query(f"""
SELECT doc_id, {' + '.join(f'({d})' for d in _DIM_SQL)} AS passed, {' + '.join(f'({d})' for d in _DIM_SQL)} = 5 AS all_pass, {' + '.join(f'({d})' for d in _DIM_SQL)} >= 4 AS mostly, 'some' AS issues
FROM labels WHERE doc_id % 11 <> 0""")
def q31_critique_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "labels").select("doc_id", parse.parse_critique(_critique_xml()).alias("c")).where("c IS NOT NULL")
    total = F.lit(0)
    for d in CRITIQUE_DIMENSIONS:
        total = total + F.col(f"c.{d}").cast("int")
    return found.select("doc_id", total.alias("passed"), "c.all_pass", parse.critique_passes(F.col("c"), 0.8).alias("mostly"), "c.issues")


_TEMPLATE = "Level: {level}\n{context_block}\nQuestion: {question}\nAnswers:\n{candidates}\nReply with one letter."


@query(f"""
SELECT conv_id, turn, md5('Level: ' || [{', '.join(repr(n) for n in LEVELS)}][turn % 6 + 1] || chr(10) || 'Context:' || chr(10) || substr(text, 1, 2000) || chr(10) || 'Question: ' || role || chr(10) || 'Answers:' || chr(10)
  || '  A. ' || role || chr(10) || '  B. none' || chr(10) || 'Reply with one letter.') AS prompt_md5 FROM conversations""")
def q32_prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.element_at(F.array(*(F.lit(n) for n in LEVELS)), (F.col("turn") % 6 + 1).cast("int"))
    answers = prompts.candidates(F.array(F.concat(F.lit("A. "), F.col("role")), F.lit("B. none")), "  ")
    made = prompts.answer_prompt("standard", {"standard": _TEMPLATE}, level=level, context_block=prompts.context_block(text(), "with_context", "Context:"), question=F.col("role"), candidates=answers)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(made).alias("prompt_md5"))


@query("SELECT conv_id, turn, role, r AS rank FROM (SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY role ORDER BY (conv_id * 7919 + turn * 104729) % 10007, conv_id, turn) AS INTEGER) AS r FROM conversations) WHERE r <= 3")
def q33_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct((F.col("conv_id") * 7919 + F.col("turn") * 104729) % 10007, "conv_id", "turn")
    return relational.exemplars(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), 3, "role", order)


@query("SELECT event_type AS phase, count(*) AS steps, count(*) FILTER (value > 50) AS completed FROM events GROUP BY event_type")
def q34_progress_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = read(spark, sf_dir, "events").select(F.col("event_type").alias("phase"), (F.col("value") > 50).alias("completed"))
    return manifest.progress_counts(steps)


@query("SELECT coalesce(lang, 'general') AS legal_domain, count(*) AS n FROM documents GROUP BY ALL")
def q35_partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_folder(spark, "domains")
    write_by_domain(read(spark, sf_dir, "documents").withColumnRenamed("lang", "legal_domain"), path)
    return spark.read.parquet(path).groupBy(F.col("legal_domain").cast("string").alias("legal_domain")).agg(F.count("*").alias("n"))


@query("SELECT md5(text) AS h, count(*) AS n FROM (SELECT text FROM conversations UNION ALL SELECT text FROM benchmark) GROUP BY ALL")
def q36_union_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "conversations").unionByName(read(spark, sf_dir, "benchmark"), allowMissingColumns=True)
    return both.groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT source AS name FROM documents WHERE source IS NOT NULL UNION SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL")
def q36_completed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return manifest.completed(docs.select(F.col("source").alias("name")), docs.select(F.col("lang").alias("name")), column="name")


@query(f"SELECT CAST(count(*) AS BIGINT) AS n_pairs, count(*) FILTER (converged) AS converged, round(count(*) FILTER (converged) / greatest(count(*), 1), 4) AS convergence_rate FROM ({_TRACES})")
def q37_convergence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.convergence(_traces(spark, sf_dir)).withColumn("convergence_rate", F.round("convergence_rate", 4))


@query("SELECT reader, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents CROSS JOIN (VALUES ('strict'), ('tolerant'), ('sniffed')) AS r(reader) GROUP BY reader")
def q38_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, schema = run_folder(spark, "lines"), "doc_id LONG, text STRING"
    write_jsonl(read(spark, sf_dir, "documents").select("doc_id", "text"), path)
    readers_of = {"strict": readers.read_jsonl, "tolerant": readers.read_jsonl_tolerant, "sniffed": readers.read_records}
    every = [f(spark, path, schema).agg(F.lit(name).alias("reader"), F.count("*").alias("n"), F.sum("doc_id").alias("ids"), F.sum(F.char_length("text").cast("long")).alias("chars")) for name, f in readers_of.items()]
    return every[0].unionByName(every[1]).unionByName(every[2])


@query(f"""
WITH p AS (SELECT event_id // 10 AS qa, event_id % 10 AS k, (event_id * 31 + (event_id % 10) * (event_id % 10) * 7) % 5 AS v FROM events),
c AS (SELECT qa, v, count(*) AS n, min(k) AS f FROM p WHERE v < 4 GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY qa ORDER BY n DESC, f) AS r, sum(n) OVER (PARTITION BY qa) AS t FROM c),
s AS (SELECT [{', '.join(repr(n) for n in LEVELS)}][q.qa % 6 + 1] AS level, q.qa % 4 AS truth, w.v, coalesce(w.n / w.t, 0) AS agreement FROM (SELECT DISTINCT qa FROM p) q LEFT JOIN w ON q.qa = w.qa AND r = 1)
SELECT level, count(*) AS total_questions, count(*) FILTER (v = truth) AS correct, round(count(*) FILTER (v = truth) / count(*), 4) AS accuracy, round(avg(agreement), 4) AS sc_agreement_rate FROM s GROUP BY level""")
def q39_result_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, qa = F.col("event_id") % 10, F.floor(F.col("event_id") / 10)
    v = (F.col("event_id") * 31 + k * k * 7) % 5
    level = F.element_at(F.array(*(F.lit(n) for n in LEVELS)), (qa % 6 + 1).cast("int"))
    letter = lambda n: F.chr((F.lit(65) + n).cast("int"))
    answers = read(spark, sf_dir, "events").select(
        qa.alias("qa_id"), level.alias("level"), F.concat(letter(qa % 4), F.lit(". yes")).alias("ground_truth"), F.lit("self_consistency").alias("strategy"), F.lit("with_context").alias("condition"), k.alias("path"), F.concat(F.lit("so it is "), letter(v)).alias("output")
    )
    return experiments.result_cells(experiments.score_answers(answers, "stub")).select("level", "total_questions", "correct", "accuracy", "sc_agreement_rate")


@query(f"SELECT l.level, CASE WHEN l.ordinal <= 3 THEN 'do ' || lower(l.level) ELSE '' END AS definition, l.ordinal FROM (VALUES {_LEVEL_ROWS}) AS l(level, ordinal)")
def q40_level_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = levels(spark).where("ordinal <= 3").select("level", F.concat(F.lit("do "), F.lower("level")).alias("definition"))
    return relational.with_level_texts(levels(spark), known, "definition")


@query(f"""
WITH pool AS (SELECT conv_id, turn, [{', '.join(repr(n) for n in LEVELS)}][conv_id % 4 + 1] AS level FROM conversations),
own AS (SELECT level, row_number() OVER (PARTITION BY level ORDER BY conv_id, turn) AS r, conv_id, turn FROM pool),
any_level AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS r, conv_id, turn FROM pool)
SELECT level, CAST(r AS INTEGER) AS rank, conv_id, turn FROM own WHERE r <= 2
UNION ALL SELECT l.level, CAST(r AS INTEGER), conv_id, turn FROM any_level CROSS JOIN (VALUES {_LEVEL_ROWS}) AS l(level, ordinal) WHERE r <= 2 AND l.level NOT IN (SELECT level FROM pool)""")
def q41_exemplars_or_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.element_at(F.array(*(F.lit(n) for n in LEVELS)), (F.col("conv_id") % 4 + 1).cast("int"))
    pool = read(spark, sf_dir, "conversations").select("conv_id", "turn", level.alias("level"))
    return relational.exemplars_or_any(levels(spark), pool, 2, F.struct("conv_id", "turn")).select("level", "rank", "conv_id", "turn")
