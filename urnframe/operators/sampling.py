"""Allocation of a count to weighted entries and seeded weighted sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urnframe.functions.columns import uniform
from urnframe.session import checkpoint_frame

SCALE = 1_000_000  # scores are compared as whole millionths
MAX_TRIES = 1000  # attempts per wanted combination
MAX_ENTRIES = 20  # entries of a selection


def allocate_count(entries: DataFrame, count: int) -> DataFrame:
    """Split ``count`` over the entries of each scope by score.

    Whole shares of the integer micro-scores first; what is left goes one each by micro-score,
    ties to the lower rank. Entries are a selection (at most 20 per scope). A zero total fails.
    """
    micros = F.round(F.col("score") * SCALE).cast("long")
    whole = W.partitionBy("lottery_id")
    order = whole.orderBy(F.desc("_m"), "rank")
    shared = entries.withColumn("_m", micros).withColumn("_t", F.sum("_m").over(whole))
    total = F.when(F.col("_t") == 0, F.raise_error(F.lit("total score is zero"))).otherwise(
        F.col("_t")
    )
    based = shared.withColumn("_t", total.cast("long")).withColumn(
        "_base", F.expr(f"_m * {count} div _t")
    )
    placed = based.withColumn("_left", F.lit(count) - F.sum("_base").over(whole)).withColumn(
        "_place", F.row_number().over(order)
    )
    extra = (F.col("_place") <= F.col("_left")).cast("long")
    return placed.select(*entries.columns, (F.col("_base") + extra).alias("allocated"))


def weighted_pool(entries: DataFrame, distribution: DataFrame) -> DataFrame:
    """Weight of every number under every entry: probability x entry score."""
    return entries.join(distribution, "lottery_id").select(
        *entries.columns, "number", (F.col("probability") * F.col("score")).alias("weight")
    )


def validate_combination(
    numbers: Column, pick: Column, low: Column, high: Column, super_number: Column | None = None,
    super_low: Column | None = None, super_high: Column | None = None,
) -> Column:
    """Exact size, distinct, in range, ascending, super number in its range when given."""
    n = F.size(numbers)
    steps = F.zip_with(F.slice(numbers, 1, n - 1), F.slice(numbers, 2, n - 1), lambda a, b: b > a)
    rising = (n < 2) | F.forall(steps, lambda s: s)
    ok = (n == pick) & F.forall(numbers, lambda x: x.between(low, high)) & rising
    if super_number is not None:
        inside = F.coalesce(super_number.between(super_low, super_high), F.lit(False))
        ok = ok & (super_number.isNull() | inside)
    return ok


def set_text(numbers: str = "numbers") -> Column:
    ordered = F.sort_array(F.array_distinct(numbers))
    return F.array_join(ordered.cast("array<string>"), ",")


def dedupe_combinations(rows: DataFrame, by: list[str], numbers: str = "numbers") -> DataFrame:
    """Distinct as sets within ``by``; the first attempt of a set stays."""
    keyed = rows.withColumn("set", set_text(numbers))
    others = [c for c in keyed.columns if c not in (*by, "set")]
    first = F.min_by(F.struct(*others), "attempt")
    return keyed.groupBy(*by, "set").agg(first.alias("r")).select(*by, "set", "r.*")


def cumulative(pool: DataFrame) -> DataFrame:
    """Weights of each entry as an ordered array of upper bounds in (0, 1], one per number."""
    order = W.partitionBy("lottery_id", "rank").orderBy("number")
    whole = W.partitionBy("lottery_id", "rank")
    running_sum = F.sum("weight").over(order) / F.sum("weight").over(whole)
    steps = pool.select("lottery_id", "rank", "number", running_sum.alias("upper"))
    return steps.groupBy("lottery_id", "rank").agg(
        F.sort_array(F.collect_list(F.struct("upper", "number"))).alias("steps")
    )


def sample_combinations(
    entries: DataFrame, pool: DataFrame, lottery: DataFrame, seed: int, tries: int = 20
) -> DataFrame:
    """Seeded weighted combinations, as many per entry as ``allocated`` says.

    Each attempt picks ``numbers_to_select`` numbers with replacement by inverse cumulative
    weight and counts only when the numbers are distinct, so a set keeps a probability
    proportional to the product of its weights. Entries are served by rank and a set already
    produced for the lottery is skipped. Attempts are rows, so they spread over the cluster;
    every entry gets ``tries`` times its allocation, doubled until all are served, and the job
    fails when ``MAX_TRIES`` times were not enough.
    """
    rules = lottery.select("lottery_id", "min_number", "max_number", "numbers_to_select")
    wanted = entries.select("lottery_id", "rank", "allocated").where(F.col("allocated") > 0)
    bounds = cumulative(pool)

    ranks = sorted(r[0] for r in wanted.select("rank").distinct().limit(MAX_ENTRIES + 1).collect())
    if len(ranks) > MAX_ENTRIES:
        raise ValueError(f"a selection has at most {MAX_ENTRIES} entries")

    def attempts(per_unit: int) -> DataFrame:
        upto = F.sequence(F.lit(1).cast("long"), F.col("allocated") * per_unit)
        rows = wanted.select("*", F.explode(upto).alias("attempt"))
        ruled = rows.join(bounds, ["lottery_id", "rank"]).join(rules, "lottery_id")
        parts = [F.lit(seed), F.col("lottery_id"), F.col("rank"), F.col("attempt")]
        picks = F.transform(
            F.sequence(F.lit(1), F.col("numbers_to_select")),
            lambda i: F.element_at(
                F.filter("steps", lambda s: s["upper"] > uniform(*parts, i)), 1
            )["number"],
        )
        made = ruled.withColumn("numbers", F.sort_array(picks))
        valid = validate_combination(
            F.col("numbers"),
            F.col("numbers_to_select"),
            F.col("min_number"),
            F.col("max_number"),
        )
        kept = made.where(valid).select("lottery_id", "rank", "allocated", "attempt", "numbers")
        return dedupe_combinations(kept, ["lottery_id", "rank"])

    per_unit = tries
    while True:
        distinct = checkpoint_frame(attempts(per_unit))
        kept = None
        for rank in ranks:
            own = distinct.where(F.col("rank") == rank)
            if kept is not None:
                own = own.join(kept.select("lottery_id", "set"), ["lottery_id", "set"], "left_anti")
            order = W.partitionBy("lottery_id").orderBy("attempt")
            first = own.withColumn("position", F.row_number().over(order).cast("long"))
            first = first.where(F.col("position") <= F.col("allocated"))
            kept = first if kept is None else kept.unionByName(first)
        kept = checkpoint_frame(kept)
        served = kept.groupBy("lottery_id", "rank").agg(F.count("*").alias("_n"))
        short = wanted.join(served, ["lottery_id", "rank"], "left").where(
            F.coalesce(F.col("_n"), F.lit(0)) < F.col("allocated")
        )
        if short.isEmpty():
            return kept.select("lottery_id", "rank", "position", "numbers")
        if per_unit >= MAX_TRIES:
            raise ValueError("combination space exhausted")
        per_unit = min(per_unit * 2, MAX_TRIES)


def list_generated(headers: DataFrame) -> DataFrame:
    return headers.orderBy(F.desc("version"))


def combinations_of(rows: DataFrame) -> DataFrame:
    return rows.orderBy("lottery_id", "rank", "position")
