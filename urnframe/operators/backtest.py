"""Walk-forward backtests over all visible draws, ordered by date and draw number.

A lottery may hold any number of draws of one day. Ordinals come from a table of days (bounded by
the calendar) and the chunked ordinal inside a day, so no window runs over a lottery's draws.
Training never touches the day on which evaluation begins: the edge between both moves to the next
date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urnframe.functions.columns import hash_int, rounded
from urnframe.operators.probability import pick_column
from urnframe.plans.series import dense_index, running
from urnframe.session import checkpoint_frame

LOTTERY = ["lottery_id"]
EVAL = ["lottery_id", "window", "draw_number"]
METRICS = ["hit_rate", "average_matches", "consistency_score"]
SPAN = 32  # draws between two stored prefix counts


def days(draws: DataFrame) -> DataFrame:
    """One row per lottery and date: draws, ordinal of its first one and of the next date's first."""
    counted = draws.groupBy("lottery_id", "draw_date").agg(F.count("*").alias("_n"))
    order = W.partitionBy("lottery_id").orderBy("draw_date")  # at most one row a calendar day
    upto = F.sum("_n").over(order)
    return counted.select(
        "lottery_id", "draw_date", "_n", (upto - F.col("_n")).alias("day_from"), upto.alias("day_to"),
        F.datediff("draw_date", F.lag("draw_date").over(order)).alias("_gap"),
    )


def by_day(draws: DataFrame) -> DataFrame:
    """Add ``idx``, the draw's ordinal by (draw_date, draw_number), and ``day_to``, that of the next date's first."""
    inside = dense_index(draws, ["lottery_id", "draw_date"], "draw_number", "_in")
    placed = inside.join(days(draws).select("lottery_id", "draw_date", "day_from", "day_to"), ["lottery_id", "draw_date"])
    return placed.withColumn("idx", F.col("day_from") + F.col("_in")).drop("day_from", "_in")


def train_count(draws: DataFrame, years: int) -> DataFrame:
    """Draws that make up ``years`` at the median gap between draws, at least one.

    The gaps are counted, not sorted: all but the first draw of a day are 0 days behind another one.
    """
    gaps = F.array(
        F.struct(F.col("_gap").alias("days"), F.lit(1).cast("long").alias("times")),
        F.struct(F.lit(0).alias("days"), (F.col("_n") - 1).alias("times")),
    )
    counted = days(draws).select("lottery_id", "_n", F.posexplode(gaps).alias("_at", "g"))
    usable = F.col("g.days").isNotNull() & (F.col("g.times") > 0)
    stats = counted.groupBy("lottery_id").agg(
        F.sum(F.when(F.col("_at") == 0, F.col("_n"))).alias("draws"),
        F.percentile(F.when(usable, F.col("g.days")), 0.5, F.when(usable, F.col("g.times")).otherwise(0)).alias("_median"),
    )
    median = F.when(F.coalesce(F.col("_median"), F.lit(0)) <= 0, F.lit(1.0)).otherwise(
        F.col("_median")
    )
    count = F.greatest(F.floor(F.lit(years * 365) / median), F.lit(1))
    few = F.when(F.col("draws") < 2, F.col("draws")).otherwise(count)
    return stats.select("lottery_id", "draws", few.cast("long").alias("train_count"))


def check_data_floor(counts: DataFrame, min_train_draws: int = 100) -> DataFrame:
    """Fail when a lottery has too few draws or too short a training range."""
    short = counts.where(
        (F.col("draws") < min_train_draws) | (F.col("train_count") < min_train_draws)
    )
    if not short.isEmpty():
        raise ValueError(f"a lottery has fewer than {min_train_draws} draws to train on")
    return counts


def walk_forward_windows(counts: DataFrame, indexed: DataFrame, eval_count: int, step: int) -> DataFrame:
    """Bounds of every window: train [train_from, eval_from), eval [eval_from, eval_to).

    A window starts at every ``step``-th draw and trains on ``train_count`` draws and the rest of
    the last one's day, so evaluation begins with a date. Windows without ``eval_count`` draws to
    evaluate are left out.
    """
    starts = indexed.where(F.col("idx") % step == 0).select("lottery_id", F.col("idx").alias("train_from"))
    last = F.col("train_from") + F.col("train_count") - 1
    edges = indexed.select("lottery_id", F.col("idx").alias("_last"), F.col("day_to").alias("eval_from"))
    return (
        starts.join(counts, "lottery_id")
        .withColumn("_last", last)
        .join(edges, ["lottery_id", "_last"])
        .where(F.col("eval_from") + eval_count <= F.col("draws"))
        .select(
            "lottery_id",
            F.floor(F.col("train_from") / step).cast("long").alias("window"),
            "train_from",
            "eval_from",
            (F.col("eval_from") + eval_count).alias("eval_to"),
        )
    )


def evaluation_rows(windows: DataFrame, indexed: DataFrame) -> DataFrame:
    """Evaluation draws of every window: the range join as an equi-join on the ordinal."""
    slots = windows.select(
        "lottery_id",
        "window",
        F.explode(F.sequence(F.col("eval_from"), F.col("eval_to") - 1)).alias("idx"),
    )
    return slots.join(indexed, ["lottery_id", "idx"])


def window_order(windows: DataFrame, indexed: DataFrame) -> DataFrame:
    """Last training date and first evaluation date of every window."""
    dates = indexed.select("lottery_id", "idx", "draw_date")
    last = dates.select("lottery_id", (F.col("idx") + 1).alias("eval_from"), F.col("draw_date").alias("train_to"))
    first = dates.select("lottery_id", F.col("idx").alias("eval_from"), F.col("draw_date").alias("eval_start"))
    keys = ["lottery_id", "eval_from"]
    return windows.join(last, keys).join(first, keys).select(
        "lottery_id", "window", "train_to", "eval_start"
    )


def check_window_order(order: DataFrame) -> DataFrame:
    if not order.where(F.col("train_to") >= F.col("eval_start")).isEmpty():
        raise ValueError("a window evaluates before its training range ends")
    return order


# --- predictors: (lottery_id, window, draw_number, predictor, picks) --------

Strategy = Callable[[DataFrame, DataFrame, DataFrame, DataFrame], DataFrame]
STRATEGIES: dict[str, Strategy] = {}


def register_strategy(name: str):
    """Register ``fn(evals, windows, indexed, lottery) -> (EVAL columns, picks)``.

    ``windows`` bounds what a strategy may look at: draws in [train_from, eval_from).
    """

    def wrap(fn: Strategy) -> Strategy:
        STRATEGIES[name] = fn
        return fn

    return wrap


def static_picks(k: int = 5) -> Column:
    return F.array(*[F.lit(i) for i in range(1, k + 1)])


def uniform_benchmark(evals: DataFrame, lottery: DataFrame, seed: int, k: int = 5) -> DataFrame:
    """``k`` distinct numbers of the pool, seeded per window and draw."""
    rules = lottery.select("lottery_id", "min_number", "max_number")
    ruled = evals.select(*EVAL).join(rules, "lottery_id")
    picks = pick_column(EVAL, seed, F.col("min_number"), F.col("max_number"), F.lit(k))
    return ruled.select(*EVAL, F.sort_array(picks).alias("picks"))


def hypergeometric_benchmark(evals: DataFrame, lottery: DataFrame, seed: int, k: int = 5):
    """``k`` equally likely numbers with replacement, so a number may repeat."""
    rules = lottery.select("lottery_id", "min_number", "max_number")
    ruled = evals.select(*EVAL).join(rules, "lottery_id")
    pool = F.col("max_number") - F.col("min_number") + 1
    picks = F.transform(
        F.sequence(F.lit(1), F.lit(k)),
        lambda i: (
            hash_int(F.lit(seed), *[F.col(c) for c in EVAL], i) % pool + F.col("min_number")
        ).cast("int"),
    )
    return ruled.select(*EVAL, F.sort_array(picks).alias("picks"))


def strategy_model(scores: DataFrame, k: int = 5) -> DataFrame:
    """Top ``k`` numbers of every draw by a model's score; at most the universe per draw."""
    order = W.partitionBy("lottery_id", "draw_number").orderBy(F.desc("score"), "number")
    top = scores.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return top.groupBy("lottery_id", "draw_number").agg(
        F.sort_array(F.collect_list("number")).alias("picks")
    )


def train_frequencies(windows: DataFrame, indexed: DataFrame, lottery: DataFrame, span: int = SPAN) -> DataFrame:
    """Appearances of every number in the training range of every window.

    Difference of two prefix counts at the range's edges. A prefix count is a running count over
    spans of ``span`` draws and what lies inside the edge's own span; no training row is expanded.
    """
    universe = lottery.select(
        "lottery_id", F.explode(F.sequence("min_number", "max_number")).alias("number")
    )
    at = F.floor(F.col("idx") / span).cast("long").alias("_span")
    members = indexed.select("lottery_id", "idx", at, F.explode("numbers").alias("number"))
    found = members.groupBy("lottery_id", "_span", "number").agg(F.count("*").alias("_n"))
    spans = indexed.where(F.col("idx") % span == 0).select("lottery_id", at)
    grid = spans.join(universe, "lottery_id").join(found, ["lottery_id", "_span", "number"], "left")
    prefix = running(
        grid.withColumn("_n", F.coalesce("_n", F.lit(0))), ["lottery_id", "number"], "_span", {"_c": ("sum", F.col("_n"))},
        exclusive=True,
    )
    ends = F.array(
        F.struct(F.col("train_from").alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("eval_from").alias("at"), F.lit(1).alias("sign"))
    )
    edges = windows.select("lottery_id", "window", F.explode(ends).alias("e")).select(
        "lottery_id", "window", "e.at", "e.sign", F.floor(F.col("e.at") / span).cast("long").alias("_span")
    )
    keys = ["lottery_id", "_span"]
    whole = edges.join(prefix.select(*keys, "number", "_c"), keys).select(
        "lottery_id", "window", "number", (F.col("sign") * F.coalesce("_c", F.lit(0))).alias("n")
    )
    part = edges.join(members.join(universe, ["lottery_id", "number"], "left_semi"), keys).where(F.col("idx") < F.col("at"))
    inside = part.select("lottery_id", "window", "number", F.col("sign").cast("long").alias("n"))
    return whole.unionByName(inside).groupBy("lottery_id", "window", "number").agg(F.sum("n").alias("n"))


def _frequency_picks(evals, windows, indexed, lottery, descending: bool, k: int = 5):
    counts = train_frequencies(windows, indexed, lottery)
    first = F.desc("n") if descending else F.asc("n")
    order = W.partitionBy("lottery_id", "window").orderBy(first, "number")
    top = counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    picks = top.groupBy("lottery_id", "window").agg(
        F.sort_array(F.collect_list("number")).alias("picks")
    )
    return evals.select(*EVAL).join(picks, ["lottery_id", "window"])


@register_strategy("most_frequent")
def most_frequent(evals, windows, indexed, lottery) -> DataFrame:
    return _frequency_picks(evals, windows, indexed, lottery, descending=True)


@register_strategy("least_frequent")
def least_frequent(evals, windows, indexed, lottery) -> DataFrame:
    return _frequency_picks(evals, windows, indexed, lottery, descending=False)


@register_strategy("last_numbers")
def last_numbers(evals, windows, indexed, lottery) -> DataFrame:
    """The numbers of the last training draw."""
    before = indexed.select(
        "lottery_id", (F.col("idx") + 1).alias("eval_from"), F.sort_array("numbers").alias("picks")
    )
    picks = windows.join(before, ["lottery_id", "eval_from"]).select("lottery_id", "window", "picks")
    return evals.select(*EVAL).join(picks, ["lottery_id", "window"])


def predictions(
    evals: DataFrame,
    lottery: DataFrame,
    seed: int = 11,
    k: int = 5,
) -> DataFrame:
    """Static pick and both seeded benchmarks for every evaluation draw, in one pass."""
    rules = lottery.select("lottery_id", "min_number", "max_number")
    ruled = evals.join(rules, "lottery_id")
    low, high = F.col("min_number"), F.col("max_number")
    uniform = pick_column(EVAL, seed, low, high, F.lit(k))
    repeated = F.transform(
        F.sequence(F.lit(1), F.lit(k)),
        lambda i: (
            hash_int(F.lit(seed), *[F.col(c) for c in EVAL], i) % (high - low + 1) + low
        ).cast("int"),
    )
    choices = F.array(
        F.struct(F.lit("static").alias("predictor"), static_picks(k).alias("picks")),
        F.struct(F.lit("uniform").alias("predictor"), F.sort_array(uniform).alias("picks")),
        F.struct(F.lit("hypergeometric").alias("predictor"), F.sort_array(repeated).alias("picks")),
    )
    return ruled.select(*EVAL, "numbers", F.explode(choices).alias("p")).select(
        *EVAL, "numbers", "p.predictor", "p.picks"
    )


def baseline_predictions(evals, windows, indexed, lottery, names: list[str] | None = None):
    """Picks of the registered train-range strategies."""
    out = None
    actual = evals.select(*EVAL, "numbers")
    for name in names or STRATEGIES:
        picks = STRATEGIES[name](evals, windows, indexed, lottery).select(*EVAL, "picks")
        rows = actual.join(picks, EVAL).select(
            *EVAL, "numbers", F.lit(name).alias("predictor"), "picks"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


# --- metrics ---------------------------------------------------------------


def match_counts(predicted: DataFrame) -> DataFrame:
    """Distinct predicted numbers that were drawn."""
    hits = F.size(F.array_intersect(F.array_distinct("picks"), F.col("numbers")))
    return predicted.withColumn("matches", hits.cast("long"))


def window_metrics(matched: DataFrame, k_threshold: int = 1) -> DataFrame:
    """Hit rate, mean and population deviation of the matches of every window."""
    hit = (F.col("matches") >= k_threshold).cast("double")
    return matched.groupBy("lottery_id", "predictor", "window").agg(
        rounded(F.avg(hit), 8).alias("hit_rate"),
        rounded(F.avg("matches"), 8).alias("average_matches"),
        rounded(F.stddev_pop("matches"), 8).alias("consistency_score"),
        F.count("*").alias("draws_evaluated"),
    )


def match_distribution(matched: DataFrame, by_window: bool = False) -> DataFrame:
    keys = ["lottery_id", "predictor"] + (["window"] if by_window else [])
    return matched.groupBy(*keys, "matches").agg(F.count("*").alias("n"))


def aggregate_windows(per_window: DataFrame) -> DataFrame:
    """Draw-weighted rates and the weighted root mean square of the deviations."""
    n = F.col("draws_evaluated")
    total = F.sum(n)
    sd = F.col("consistency_score")
    return per_window.groupBy("lottery_id", "predictor").agg(
        rounded(F.sum(F.col("hit_rate") * n) / total, 8).alias("hit_rate"),
        rounded(F.sum(F.col("average_matches") * n) / total, 8).alias("average_matches"),
        rounded(F.sqrt(F.sum(sd * sd * n) / total), 8).alias("consistency_score"),
        total.alias("draws_evaluated"),
        F.count("*").alias("windows"),
    )


def plan_windows(draws: DataFrame, years: int, eval_count: int, step: int, floor: int = 100):
    """Indexed draws (a written table) and checked windows of a backtest."""
    counts = check_data_floor(train_count(draws, years), floor)
    indexed = checkpoint_frame(by_day(draws))
    return indexed, walk_forward_windows(counts, indexed, eval_count, step)


def backtest(
    draws: DataFrame,
    lottery: DataFrame,
    years: int = 2,
    eval_count: int = 30,
    step: int = 30,
    seed: int = 11,
    floor: int = 100,
    strategies: bool = True,
) -> DataFrame:
    """Per-window metrics of the static pick, both benchmarks and the registered strategies."""
    indexed, windows = plan_windows(draws, years, eval_count, step, floor)
    evals = evaluation_rows(windows, indexed)
    rows = predictions(evals, lottery, seed)
    if strategies:
        rows = rows.unionByName(baseline_predictions(evals, windows, indexed, lottery))
    return window_metrics(match_counts(rows))


def backtest_history(results: DataFrame, lottery_id: int) -> DataFrame:
    """Results of one lottery, newest version first."""
    return results.where(F.col("lottery_id") == lottery_id).orderBy(
        F.desc("version"), "predictor"
    )


def backtest_results(results: DataFrame, version: int | None = None) -> DataFrame:
    """One version, or the newest of every lottery and predictor."""
    if version is not None:
        return results.where(F.col("version") == version)
    others = [c for c in results.columns if c not in ("lottery_id", "predictor")]
    newest = F.max_by(F.struct(*others), "version")
    return results.groupBy("lottery_id", "predictor").agg(newest.alias("r")).select(
        "lottery_id", "predictor", "r.*"
    )
