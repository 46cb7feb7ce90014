"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Target weights are put on a grid of ``cycle`` shares, so source i has w_i of every ``cycle`` slots. Its documents, shuffled by
hash, are cut into blocks of ``block_rows``. Block k of a source of weight w has the release time floor(k * cycle / w) and
the deadline ceil((k + 1) * cycle / w); in each slot the released block of the earliest deadline goes next. On one line of
slots that order keeps every source within one block of its share at every slot. The order repeats after ``cycle`` slots, so
one cycle is computed (a fold over ``cycle`` slots in one row) and block k of a source stands at
(k div w_i) * cycle + the slot of its (k mod w_i)-th turn: every document's slot follows by itself.

Nothing is dropped or repeated. Where a source ends before the others, its slots stay empty; ``balanced`` tells the documents
up to the first such end, for which the bound holds.

Scale: a source's ranks are counted in hash ranges of about ``range_rows`` documents, and offsets of ranges are summed in two
steps, so a source with a third of all rows is many tasks' work and no task has all ranges. Rows of an id that is repeated more
than ``range_rows`` times are dealt into ranges of their own by row. Broadcast are the cycle's slots: ``cycle`` rows, by
default the least multiple of 1,024 that has a slot for each source; a given one must be no less than their number. The fold
over a cycle is work of sources times slots in one task. Positions are counted in stretches of slots in the same way.

Cases: a null source is a source of its own. Null ids are shuffled by row. Repeated ids are rows of their own, each with a
position of its own (their order follows the input's; those of an id repeated more than ``range_rows`` times stand after the
others of their hash range). Sources without a given weight get the least, one share. An empty table gives no rows. Extra
columns are ignored and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import fresh, materialise, partitions, sums_before, table, with_place


def shares(counts: DataFrame, weights: dict[str, float] | None, temperature: float, cycle: int) -> DataFrame:
    """(source, w): integers of at least one that add up to ``cycle``, by largest remainders."""
    if weights is None:
        aim = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        aim = F.lit(0.0)
        for source, weight in weights.items():
            aim = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(weight))).otherwise(aim)
    every = W.partitionBy(F.lit(0))  # a row a source
    aimed = counts.withColumn("aim", aim).withColumn("free", F.lit(cycle) - F.count("*").over(every))
    part = aimed.withColumn("exact", F.coalesce(F.col("free") * F.try_divide(F.col("aim"), F.sum("aim").over(every)), F.lit(0.0)))
    whole = part.withColumn("q", F.floor("exact").cast("int")).withColumn("left", F.col("free") - F.sum("q").over(every))
    rank = F.row_number().over(every.orderBy(F.desc(F.col("exact") - F.col("q")), "source"))
    return whole.withColumn("r", rank).select("source", (F.lit(1) + F.col("q") + F.floor(F.col("left") / F.count("*").over(every)).cast("int") + (F.col("r") <= F.pmod("left", F.count("*").over(every))).cast("int")).cast("int").alias("w"))


def schedule(weights: DataFrame, cycle: int) -> DataFrame:
    """(source, w, turn, slot): the slots of one cycle by earliest deadline among released blocks."""
    one = weights.agg(F.sort_array(F.collect_list(F.struct("source", "w"))).alias("s"))  # a row a source, at most ``cycle``
    fold = f"""aggregate(sequence(0, {cycle - 1}),
      named_struct('done', transform(s, x -> 0), 'plan', CAST(array() AS ARRAY<STRUCT<i: INT, turn: INT>>)),
      (state, t) -> transform(array(array_min(filter(
          transform(sequence(0, size(s) - 1), i -> named_struct(
            'due', ((state.done[i] + 1) * {cycle} + s[i].w - 1) div s[i].w, 'i', i,
            'free', state.done[i] < s[i].w AND (state.done[i] * {cycle}) div s[i].w <= t)),
          b -> b.free))),
        best -> named_struct('done', transform(state.done, (d, i) -> d + if(i = best.i, 1, 0)),
                             'plan', concat(state.plan, array(named_struct('i', best.i, 'turn', state.done[best.i])))))[0])"""
    planned = one.where("size(s) > 0").select("s", F.posexplode(F.expr(f"({fold}).plan")).alias("slot", "p"))
    return planned.selectExpr("s[p.i].source AS source", "s[p.i].w AS w", "p.turn AS turn", "slot")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, cycle: int | None = None, block_rows: int = 16, range_rows: int = 2048, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, weight (of ``cycle``), block, slot, place, position, balanced.

    ``cycle`` None is the least multiple of 1,024 that has a slot for each source. ``weights`` are target weights by source; None takes each source's count to the power ``temperature``.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.monotonically_increasing_id().alias("rid"))
    return _mixed(materialise(base, "mix-ids"), weights, temperature, cycle, block_rows, range_rows).drop("rid")


def _mixed(base: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, cycle: int | None = None, block_rows: int = 16, range_rows: int = 2048) -> DataFrame:
    """``mix`` of written rows (doc_id, source, rid), ``rid`` (any order, no two alike) kept."""
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row"), F.to_json(F.struct("rid")))))
    counts = materialise(base.groupBy("source").agg(F.count("*").alias("n")), "mix-counts")
    total = counts.agg(F.sum("n"), F.count("*")).first()
    cycle = cycle or 1024 * max(1, -(-(total[1] or 0) // 1024))
    if (total[1] or 0) > cycle:
        raise ValueError(f"{total[1]} sources share a cycle of {cycle} slots: raise cycle")
    digits = max(1, min(8, -(-max(1, (total[0] or 0) // range_rows).bit_length() // 4)))
    base = base.withColumn("h", order).withColumn("part", F.substring("h", 1, digits))
    often = materialise(base.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("c")).where(F.col("c") > range_rows).select(F.col("doc_id").alias("again")), "mix-repeated")
    if often.limit(1).count():  # '~' sorts after hexadecimal digits
        spread = F.concat("part", F.lit("~"), F.substring("h", 1, 16), F.substring(F.md5(F.to_json(F.struct("rid"))), 1, digits))
        base = base.join(often, F.col("doc_id") == F.col("again"), "left").withColumn("part", F.when(F.col("again").isNull(), F.col("part")).otherwise(spread)).drop("again")
    sizes = base.groupBy("source", "part").agg(F.count("*").alias("c"))
    offsets = sums_before(sizes, ["source"], "part", "c", F.substring("part", 1, (digits + 1) // 2)).select(F.col("source").alias("s2"), F.col("part").alias("p2"), F.col("before").alias("offset"))
    inner = F.row_number().over(W.partitionBy("source", "part").orderBy("h", "doc_id", "rid")) - 1
    ranked = base.withColumn("inner", inner).join(offsets, F.col("source").eqNullSafe(F.col("s2")) & (F.col("part") == F.col("p2")))
    ranked = ranked.select("doc_id", "rid", "source", (F.col("inner") + F.col("offset")).alias("rank"))
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block_rows)).withColumn("place", (F.col("rank") % block_rows).cast("int"))

    turns = materialise(schedule(shares(counts, weights, temperature, cycle), cycle).repartition(1), "mix-cycle")
    plan = turns.select(F.col("source").alias("s3"), F.col("w").alias("weight"), "turn", F.col("slot").alias("at"))
    weight_of = turns.where("turn = 0").select(F.col("source").alias("s4"), "w")
    slotted = ranked.join(F.broadcast(weight_of), F.col("source").eqNullSafe(F.col("s4")))
    slotted = slotted.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("s3")) & (F.col("turn") == F.col("block") % F.col("w")))
    slotted = materialise(slotted.select("doc_id", "rid", "source", "weight", "block", (F.floor(F.col("block") / F.col("w")) * cycle + F.col("at")).alias("slot"), "place"), "mix-slots")

    # Positions: slots are counted by stretches of 512, and those by 4,096 of them.
    per = slotted.groupBy("slot").agg(F.count("*").alias("c")).withColumn("stretch", F.floor(F.col("slot") / 512))
    stretches = sums_before(per.groupBy("stretch").agg(F.sum("c").alias("c")), [], "stretch", "c", F.floor(F.col("stretch") / 4096)).select("stretch", F.col("before").alias("ahead"))
    within = F.coalesce(F.sum("c").over(W.partitionBy("stretch").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = per.withColumn("within", within).join(stretches, "stretch").select("slot", (F.col("ahead") + F.col("within")).alias("start"))
    ends = slotted.groupBy("source").agg(F.max("slot").alias("last")).agg(F.min("last").alias("first_end"))
    lined = F.row_number().over(W.partitionBy("slot").orderBy("place")) - 1
    return (
        slotted.withColumn("lined", lined).join(starts, "slot").join(F.broadcast(ends))
        .select("doc_id", "rid", "source", "weight", "block", "slot", "place", (F.col("start") + F.col("lined")).alias("position"), (F.col("slot") <= F.col("first_end")).alias("balanced"))
    )


def mix_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """``docs`` in the order of the mixture, same rows and columns: sorted within range partitions of ascending position.

    Rows are told apart by the file and place they were read from, so null and repeated ids have positions of their own.
    """
    path, row, at = (fresh(docs, c) for c in ("mix_path", "mix_row", "mix_position"))
    placed = with_place(docs, path, row, "mix-rows")
    base = materialise(placed.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.struct(F.col(path).alias("path"), F.col(row).alias("row")).alias("rid")), "mix-ids")
    found = _mixed(base, **options).select(F.col("rid.path").alias("found_path"), F.col("rid.row").alias("found_row"), F.col("position").alias("found_position"))
    both = placed.join(found, (placed[path] == found["found_path"]) & (placed[row] == found["found_row"])).select(*(placed[c] for c in docs.columns), found["found_position"].alias(at))
    return both.repartitionByRange(partitions(docs.sparkSession), at).sortWithinPartitions(at).drop(at)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
e AS (SELECT source, (1024 - count(*) OVER ()) AS free, (1024 - count(*) OVER ()) * (pow(n, 0.5) / sum(pow(n, 0.5)) OVER ()) AS exact FROM c),
f AS (SELECT source, exact - floor(exact) AS rest, CAST(floor(exact) AS INTEGER) AS q, free - sum(CAST(floor(exact) AS INTEGER)) OVER () AS spare FROM e),
v AS (SELECT source, 1 + q + (row_number() OVER (ORDER BY rest DESC, source) <= spare)::INTEGER AS w, row_number() OVER (ORDER BY source) AS i FROM f),
-- one source's turn k may stand anywhere from its release to its deadline; slots are filled one after another
walk AS (
  SELECT -1 AS slot, 0::BIGINT AS i, 0 AS turn, (SELECT list(0 ORDER BY i) FROM v) AS done
  UNION ALL
  SELECT slot + 1, b.i, done[b.i], list_transform(done, lambda d, j: CASE WHEN j = b.i THEN d + 1 ELSE d END)
  FROM walk, LATERAL (
    SELECT v.i FROM v WHERE walk.done[v.i] < v.w AND (walk.done[v.i] * 1024) // v.w <= walk.slot + 1
    ORDER BY ((walk.done[v.i] + 1) * 1024 + v.w - 1) // v.w, v.i LIMIT 1
  ) AS b WHERE slot < 1023
),
d AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r FROM documents
),
s AS (
  SELECT d.doc_id, d.source, v.w AS weight, r // 16 AS block, ((r // 16) // v.w) * 1024 + walk.slot AS slot, CAST(r % 16 AS INTEGER) AS place
  FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source JOIN walk ON walk.i = v.i AND walk.turn = (r // 16) % v.w AND walk.slot >= 0
)
SELECT *, row_number() OVER (ORDER BY slot, place) - 1 AS position,
       slot <= (SELECT min(m) FROM (SELECT max(slot) AS m FROM s GROUP BY source)) AS balanced
FROM s
"""
