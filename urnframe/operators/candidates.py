"""Evaluation of parameter candidates by any estimator, metric and direction, in one plan.

Candidates are rows (lottery_id, eval_num, one column for each parameter). A candidate's fitness in a
lottery is the mean of the metric over the numbers, rounded to 8 digits and negated to minimise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urnframe.operators import classifiers, training
from urnframe.plans.joins import with_dimension
from urnframe.session import checkpoint_frame

CANDIDATE = ["lottery_id", "eval_num"]
SLICE = 8  # numbers whose models one task fits on one copy of the sample


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


# Metrics of a number from its counts: said yes, was yes, both, all rows.
METRICS = {
    "accuracy": lambda said, was, both, n: _ratio(n - said - was + 2 * both, n),
    "precision": lambda said, was, both, n: _ratio(both, said),
    "recall": lambda said, was, both, n: _ratio(both, was),
    "f1": lambda said, was, both, n: _ratio(2 * both, said + was),
}


def fitness(counts: DataFrame, metric: str = "f1", minimise: bool = False) -> DataFrame:
    """(lottery_id, eval_num, fitness) from (lottery_id, eval_num, number, said, was, both, n) rows, added up."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    names = ["said", "was", "both", "n"]
    summed = counts.groupBy(*CANDIDATE, "number").agg(*[F.sum(c).alias(c) for c in names])
    value = METRICS[metric](*[F.col(c) for c in names])
    mean = F.round(F.avg(value), 8)
    return summed.groupBy(*CANDIDATE).agg((-mean if minimise else mean).alias("fitness"))


def evaluate_models(
    rows: DataFrame, models: DataFrame, candidates: DataFrame, family: str, metric: str = "f1", minimise: bool = False,
    fit_rows: int = training.FIT_ROWS, block: int = training.BLOCK_ROWS,
) -> DataFrame:
    """Fitness of every candidate for ``family``: a model per (lottery, candidate, number), scored on all evaluation rows.

    ``rows`` are those of :func:`training.training_rows`, ``models`` names the numbers. A task fits a slice
    of numbers on one copy of the lottery's sample; another scores a block of evaluation rows and
    returns counts, not scores.
    """
    rows = checkpoint_frame(rows)
    parameters = [c for c in candidates.columns if c not in CANDIDATE]
    number = F.col("number").cast("int").alias("number")
    wanted = models.select(F.col("lottery_id").cast("int").alias("lottery_id"), number, F.pmod("number", F.lit(SLICE)).cast("int").alias("_slice"))
    sliced = wanted.groupBy("lottery_id", "_slice").agg(F.collect_list("number").alias("numbers"))  # of the universe
    values = F.to_json(F.struct(*parameters)).alias("parameters")
    jobs = sliced.join(candidates.select(F.col("lottery_id").cast("int").alias("lottery_id"), F.col("eval_num").cast("long").alias("eval_num"), values), "lottery_id")
    sample = training.fit_sample(rows, fit_rows).select(
        F.col("lottery_id").cast("int").alias("lottery_id"), "draw_number", "next_numbers", "features"
    )
    keys = ["lottery_id", "eval_num", "_slice"]
    placed = jobs.select(*[F.col(c).alias(c) for c in keys]).join(sample, "lottery_id")

    def fitted(key, drawn: pa.Table, job: pa.Table) -> pa.Table:
        import json

        known = drawn.sort_by("draw_number")
        x, nexts = training.matrix(known), known["next_numbers"].to_pylist()
        numbers, values = job["numbers"][0].as_py(), json.loads(job["parameters"][0].as_py())
        made = [classifiers.fit(family, x, np.array([float(k in n) for n in nexts]), **values) for k in numbers]
        lottery_id, eval_num, _ = (k.as_py() for k in key)
        return pa.table({
            "lottery_id": pa.array([lottery_id] * len(made), pa.int32()), "eval_num": pa.array([eval_num] * len(made), pa.int64()),
            "number": pa.array(numbers, pa.int32()), "model": pa.array(made, pa.binary()),
        })

    fits = checkpoint_frame(
        placed.groupBy(*keys).cogroup(jobs.groupBy(*keys)).applyInArrow(
            fitted, "lottery_id int, eval_num bigint, number int, model binary"
        )
    )
    held_out = rows.where("segment = 'eval'").withColumn("lottery_id", F.col("lottery_id").cast("int"))
    size = held_out.groupBy("lottery_id").agg(F.ceil(F.count("*") / block).cast("long").alias("_blocks"))
    dealt = with_dimension(held_out, size, "lottery_id").select(
        "lottery_id", "next_numbers", "features", F.pmod(F.xxhash64("draw_number"), "_blocks").alias("_block")
    )
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block")
    copies = fits.join(size, "lottery_id").select("lottery_id", "eval_num", "number", "model", every)

    def counted(draws: pa.Table, models: pa.Table) -> pa.Table:
        x, nexts, out = training.matrix(draws), draws["next_numbers"].to_pylist(), []
        for eval_num, number, model in zip(*(models[c].to_pylist() for c in ("eval_num", "number", "model"))) if len(x) else []:
            said = classifiers.score(model, x)[1] > 0.5
            was = np.array([number in n for n in nexts])
            out.append((draws["lottery_id"][0].as_py(), eval_num, number, int(said.sum()), int(was.sum()), int((said & was).sum()), len(x)))
        return pa.Table.from_pylist([dict(zip(COUNTS.names, r)) for r in out], COUNTS)

    keys = ["lottery_id", "_block"]
    counts = dealt.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(
        counted, "lottery_id int, eval_num bigint, number int, said bigint, was bigint, both bigint, n bigint"
    )
    return fitness(counts, metric, minimise)


COUNTS = pa.schema([
    ("lottery_id", pa.int32()), ("eval_num", pa.int64()), ("number", pa.int32()), ("said", pa.int64()), ("was", pa.int64()),
    ("both", pa.int64()), ("n", pa.int64()),
])


def evaluate_knn(
    neighbors: DataFrame, nexts: DataFrame, candidates: DataFrame, models: DataFrame, metric: str = "f1", minimise: bool = False
) -> DataFrame:
    """Fitness of every candidate ``k``: the majority of the ``k`` nearest training draws says yes.

    ``neighbors`` (lottery_id, draw_number, rank, neighbor) holds the evaluation draws' neighbours up to
    the largest ``k``: they are searched once for all candidates. ``nexts`` names the next numbers.
    """
    keys = ["lottery_id", "draw_number"]
    after = nexts.select("lottery_id", F.col("draw_number").alias("neighbor"), F.explode("next_numbers").alias("number"))
    voted = neighbors.join(after.hint("merge"), ["lottery_id", "neighbor"]).groupBy(*keys, "number").agg(F.collect_list("rank").alias("_ranks"))
    asked = neighbors.where("rank = 1").select(*keys)
    truth = asked.join(nexts.hint("merge"), keys)
    held = truth.select(*keys, F.explode("next_numbers").alias("number")).withColumn("_was", F.lit(1))
    by_number = held.groupBy("lottery_id", "number").agg(F.count("*").alias("was"))
    total = truth.groupBy("lottery_id").agg(F.count("*").alias("n"))
    votes = F.size(F.filter("_ranks", lambda r: r <= F.col("k")))
    rated = voted.join(truth.select(*keys).hint("merge"), keys, "left_semi").join(held.hint("merge"), [*keys, "number"], "left").join(candidates, "lottery_id")
    said = rated.where(2 * votes >= F.col("k")).groupBy(*CANDIDATE, "number").agg(
        F.count("*").alias("said"), F.count("_was").alias("both")
    )
    grid = models.select("lottery_id", "number").join(candidates.select(*CANDIDATE), "lottery_id").join(total, "lottery_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    counts = grid.join(by_number, ["lottery_id", "number"], "left").join(said, [*CANDIDATE, "number"], "left").select(
        *CANDIDATE, "number", zero("said"), zero("was"), zero("both"), "n"
    )
    return fitness(counts, metric, minimise)
