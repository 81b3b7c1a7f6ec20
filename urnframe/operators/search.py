"""Parameter search as a fan-out: sampled candidates scored in one plan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urnframe.functions.columns import hash_int, uniform
from urnframe.plans.joins import checked_broadcast
from urnframe.plans.series import running


def check_space(space: Mapping[str, Mapping[str, object]]) -> None:
    """Refuse empty ranges, single choices and unknown kinds."""
    for name, p in space.items():
        kind = p.get("type")
        if kind in ("continuous", "integer"):
            low, high = p.get("low"), p.get("high")
            if low is None or high is None or not low < high:
                raise ValueError(f"{name}: low must be below high")
        elif kind == "discrete":
            if len(p.get("choices") or []) < 2:
                raise ValueError(f"{name}: at least two choices")
        else:
            raise ValueError(f"{name}: unknown type {kind!r}")


def sample_candidates(
    scopes: DataFrame, space: Mapping[str, Mapping[str, object]], n: int, seed: int
) -> DataFrame:
    """``n`` seeded candidates per scope row: (scope columns, eval_num, one column per name).

    Continuous values are uniform in [low, high), integers in low..high-1.
    """
    check_space(space)
    keys = scopes.columns
    rows = scopes.withColumn("eval_num", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))))
    out = []
    for name, p in space.items():
        parts = [F.lit(seed), *[F.col(k) for k in keys], F.col("eval_num"), F.lit(name)]
        if p["type"] == "continuous":
            value = F.lit(float(p["low"])) + uniform(*parts) * (float(p["high"]) - float(p["low"]))
        elif p["type"] == "integer":
            value = hash_int(*parts) % (int(p["high"]) - int(p["low"])) + int(p["low"])
        else:
            choices = F.array(*[F.lit(c) for c in p["choices"]])
            value = F.element_at(choices, (hash_int(*parts) % len(p["choices"]) + 1).cast("int"))
        out.append(value.alias(name))
    return rows.select(*keys, "eval_num", *out)


def least_rounded(threshold: Column, places: int = 8) -> Column:
    """The least non-negative double that, rounded half up to ``places`` decimals, reaches ``threshold``.

    A comparison with it stands for rounding every value, which costs a decimal number each.
    """
    unit = float(10**places)
    k = F.ceil(threshold * unit)
    k = F.when((k - 1) / unit >= threshold, k - 1).when(k / unit < threshold, k + 1).otherwise(k)
    return (k * 10 - 5) / (unit * 10)


def evaluate_candidates(
    counted: DataFrame, candidates: DataFrame, minimise: bool = False
) -> DataFrame:
    """F1 of the smoothed-frequency rule of every candidate, per lottery, in one plan.

    ``counted`` has rows (lottery_id, seen, draws, label, n): ``n`` times an evaluation state. States may
    be listed more than once; on long histories hardly two are equal, so there they come with n = 1. The rule of a candidate says yes when the number
    was seen ``min_seen`` times and (seen + alpha * prior) / (draws + alpha) reaches its
    threshold at eight decimals.
    """
    small = checked_broadcast(candidates.withColumn("_least", least_rounded(F.col("threshold"))))
    rows = counted.join(small, "lottery_id")
    score = (F.col("seen") + F.col("alpha") * F.col("prior")) / (F.col("draws") + F.col("alpha"))
    said = (score >= F.col("_least")) & (F.col("seen") >= F.col("min_seen"))
    hit = F.col("label") == 1
    n = F.col("n")
    sums = rows.groupBy("lottery_id", "eval_num").agg(
        F.sum(F.when(said & hit, n).otherwise(0)).alias("tp"),
        F.sum(F.when(said & ~hit, n).otherwise(0)).alias("fp"),
        F.sum(F.when(~said & hit, n).otherwise(0)).alias("fn"),
    )
    bottom = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = F.when(bottom == 0, F.lit(0.0)).otherwise(2 * F.col("tp") / bottom)
    return sums.select("lottery_id", "eval_num", (-f1 if minimise else f1).alias("fitness"))


def convergence_history(results: DataFrame) -> DataFrame:
    """Best fitness so far at every evaluation."""
    return running(
        results.select("lottery_id", "eval_num", "fitness"),
        ["lottery_id"],
        "eval_num",
        {"best_fitness": ("max", F.col("fitness"))},
    )


def early_stop_at(history: DataFrame, patience: int) -> DataFrame:
    """First evaluation past ``patience`` whose last ``patience`` entries never improved.

    ``best_fitness`` only rises, so they never improved when the first equals the last.
    """
    order = W.partitionBy("lottery_id").orderBy("eval_num")
    before = F.lag("best_fitness", patience - 1).over(order)
    stuck = (F.col("eval_num") > patience) & (F.col("best_fitness") == before)
    flagged = history.withColumn("_stop", F.when(stuck, F.col("eval_num")))
    return flagged.groupBy("lottery_id").agg(
        F.min("_stop").alias("stop_at"), F.count("*").alias("evaluations")
    )


def best_candidate(results: DataFrame) -> DataFrame:
    """Highest fitness; the first evaluation wins ties."""
    others = [c for c in results.columns if c != "lottery_id"]
    best = F.max_by(F.struct(*others), F.struct("fitness", -F.col("eval_num")))
    return results.groupBy("lottery_id").agg(best.alias("b")).select("lottery_id", "b.*")
