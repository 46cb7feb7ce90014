"""Generate, criticise and refine in passes, until every row passes or loops run out.

A pass is one DataFrame over all rows still failing. It is written under the run's folder and read again, so lineage stays
one pass long, a lost executor costs its tasks. Passes are kept by (chunk, level): a run that starts again, with the same jobs or
with more, asks only for those that no finished pass has.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.classify import qa_id
from tessera.functions.fixed import MODES
from tessera.functions.parse import critique_passes, parse_critique, parse_qa
from tessera.sources.readers import _exists

#: A step maps a DataFrame to the same rows with a column ``output`` of generated text.
Step = Callable[[DataFrame], DataFrame]
#: What a job is known by.
KEYS = ["chunk_id", "level"]


def _pass(source: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, keys: list[str]) -> DataFrame:
    """``step`` of ``source``, written under ``path`` by key: rows whose key is listed there are not asked again.

    New keys' rows are appended as a batch of their own, with the keys asked (also of rows that ``step`` dropped); a batch
    without a finished write of both counts for nothing. Rows of keys that ``source`` lacks are left out of the result: where
    there are any, the others are written anew, so that no plan holds the passes before.
    """
    spark = source.sparkSession
    named = source.select(*(F.col(k).cast("string").alias(k) for k in keys))  # a key may repeat
    done, n = [], 0
    while _exists(spark, f"{path}/rows-{n}"):
        if _exists(spark, f"{path}/rows-{n}/_SUCCESS") and _exists(spark, f"{path}/keys-{n}/_SUCCESS"):
            done.append(n)
        n += 1
    schema = step(source).schema
    at = lambda kind, some: spark.read.schema(named.schema if kind == "keys" else schema).parquet(*(f"{path}/{kind}-{i}" for i in some))
    if not done:  # these rows are those of ``source``, and no join need tell
        step(source).write.parquet(f"{path}/rows-{n}")
        named.write.parquet(f"{path}/keys-{n}")
        return at("rows", [n])
    match = lambda a, b: functools.reduce(lambda x, y: x & y, (a[k].cast("string").eqNullSafe(b[k]) for k in keys))
    # never broadcast: keys grow with the jobs, and their files pack so well that they look small
    without = lambda a, b: a.join(b.hint("merge"), match(a, b), "left_anti")
    asked = at("keys", done)
    left = without(named, asked)
    if left.limit(1).count():
        step(without(source, asked)).write.parquet(f"{path}/rows-{n}")
        left.write.parquet(f"{path}/keys-{n}")
        done.append(n)
    made = at("rows", done)
    if not without(asked, named).limit(1).count():
        return made
    some = f"{path}/of-{uuid.uuid4().hex}"
    made.join(named.hint("merge"), match(made, named), "left_semi").write.parquet(some)
    return spark.read.schema(schema).parquet(some)


def pair_columns(loops: Column | int, converged: bool) -> list[Column]:
    loops = F.lit(loops) if isinstance(loops, int) else loops
    return [
        *(F.col(f"qa.{c}").alias(c) for c in ("question", "candidate_answers", "ground_truth", "legal_rationale")),
        F.col("level").alias("bloom_level"), qa_id(F.col("chunk_id"), F.col("level"), F.lit(0)).alias("qa_id"),
        "chunk_id", "source_doc", F.col("text").alias("context_text"), loops.cast("int").alias("refinement_loops"), F.lit(converged).alias("converged"),
    ]


def refine_in_passes(jobs: DataFrame, generator: Step, critic: Step, refiner: Step, path: str, max_loops: int = 3) -> DataFrame:
    """QA pairs of ``jobs`` (chunk_id, text, source_doc, level), refined at most ``max_loops`` times.

    Rows whose generation or refinement does not parse go; of several pairs the first counts. A critique that does not parse
    fails its row. Rows that pass in loop i have refinement_loops i; those that never do, ``max_loops`` and not converged.
    """
    keep = [*jobs.columns, "qa"]
    active = _pass(jobs, lambda d: generator(d).withColumn("qa", F.try_element_at(parse_qa(F.col("output")), F.lit(1))).where("qa IS NOT NULL").select(*keep), f"{path}/generated", KEYS)
    done = []
    for loop in range(1, max_loops + 1):
        judged = _pass(active, lambda a: critic(a).withColumn("critique", parse_critique(F.col("output"))).select(*keep, "critique"), f"{path}/critique-{loop}", KEYS)
        passed = F.coalesce(F.col("critique.all_pass"), F.lit(False))
        done.append(judged.where(passed).select(*pair_columns(loop, True)))
        failed = judged.where(~passed)
        if loop == max_loops:
            done.append(failed.select(*pair_columns(max_loops, False)))
            break
        if not failed.limit(1).count():
            break
        active = _pass(failed, lambda f: refiner(f).withColumn("qa", F.try_element_at(parse_qa(F.col("output")), F.lit(1))).where("qa IS NOT NULL").select(*keep), f"{path}/refined-{loop}", KEYS)
        if not active.limit(1).count():
            break
    pairs = done[0]
    for d in done[1:]:
        pairs = pairs.unionByName(d)
    return pairs


def refine_traced(jobs: DataFrame, generator: Step, critic: Step, refiner: Step, path: str, mode: str = "adaptive", threshold: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(pairs, traces) of one of the modes single_pass, fixed_2, fixed_3, adaptive.

    Unlike the batched passes: the threshold on passed dimensions decides; a critique that does not parse ends its row's
    loops; a refinement that does not parse keeps the former pair; fixed modes refine after passing too and never converge.
    Traces have a record per loop: loop, question and ground truth, critique, passed.
    """
    loops, adaptive = MODES[mode], mode == "adaptive"
    keep = [*jobs.columns, "n", "qa"]
    active = _pass(jobs, lambda d: generator(d).select(*jobs.columns, F.posexplode(parse_qa(F.col("output"))).alias("n", "qa")), f"{path}/generated", KEYS)
    ident = qa_id(F.col("chunk_id"), F.col("level"), F.col("n"))
    if not loops:
        whole = active.withColumn("__id", ident).select(*pair_columns(0, True), "__id").drop("qa_id").withColumnRenamed("__id", "qa_id")
        return whole, active.select(ident.alias("qa_id"), F.col("level").alias("bloom_level"), "chunk_id", F.lit(0).alias("total_loops"), F.lit(True).alias("converged"), F.array().cast("array<struct<loop:int>>").alias("loop_records"))
    ended, records = [], []
    for loop in range(1, loops + 1):
        judged = _pass(active, lambda a: critic(a).withColumn("critique", parse_critique(F.col("output"))).select(*keep, "critique"), f"{path}/critique-{loop}", [*KEYS, "n"])
        judged = judged.withColumn("passed", critique_passes(F.col("critique"), threshold))
        snapshot = F.struct(F.col("qa.question").alias("question"), F.col("qa.ground_truth").alias("ground_truth"))
        records.append(judged.select(ident.alias("qa_id"), "level", "chunk_id", F.struct(F.lit(loop).alias("loop"), snapshot.alias("qa_snapshot"), "critique", "passed").alias("record")))
        stop = F.col("critique").isNull() | (F.col("passed") if adaptive else F.lit(False)) | F.lit(loop == loops)
        ended.append(judged.where(stop).withColumn("loops", F.lit(loop)).withColumn("conv", F.col("passed") if adaptive else F.lit(False)).select(*keep, "loops", "conv"))
        going = judged.where(~stop)
        if not going.limit(1).count():
            break
        active = _pass(going, lambda g: refiner(g).withColumn("qa", F.coalesce(F.try_element_at(parse_qa(F.col("output")), F.lit(1)), F.col("qa"))).select(*keep), f"{path}/refined-{loop}", [*KEYS, "n"])
    last, every = ended[0], records[0]
    for e, r in zip(ended[1:], records[1:], strict=True):
        last, every = last.unionByName(e), every.unionByName(r)
    pairs = last.withColumn("__id", ident).select(*pair_columns(F.col("loops"), False), "__id", "conv").drop("qa_id", "converged").withColumnsRenamed({"__id": "qa_id", "conv": "converged"})
    traces = every.groupBy("qa_id", F.col("level").alias("bloom_level"), "chunk_id").agg(F.sort_array(F.collect_list("record")).alias("loop_records"))  # at most ``loops`` each
    traces = traces.join(pairs.select("qa_id", F.col("refinement_loops").alias("total_loops"), "converged").hint("merge"), "qa_id")
    return pairs, traces
