"""Probability models over draw histories; every model is a long (subject, value) table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urnframe.functions.columns import choose, factorial_of, hash_text, rounded
from urnframe.operators.scan import last_draws
from urnframe.operators.stats import draw_scope, frequency
from urnframe.plans.joins import spread, with_dimension
from urnframe.plans.series import running

MODELS: dict[str, Callable[..., DataFrame]] = {}


def register_model(name: str):
    """Register ``fn(baskets, lottery) -> (lottery_id, subject, value)`` under ``name``."""

    def wrap(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        MODELS[name] = fn
        return fn

    return wrap


def hypergeometric(params: DataFrame) -> DataFrame:
    """k = 0..picks hits when ``picks`` of ``pool`` are drawn and ``good`` of them count."""
    k = F.explode(F.sequence(F.lit(0), F.col("picks"))).alias("k")
    pool, picks, good = F.col("pool"), F.col("picks"), F.col("good")
    ways = choose(good, F.col("k")) * choose(pool - good, picks - F.col("k"))
    return params.select("*", k).select(
        *params.columns, "k", (ways / choose(pool, picks)).alias("probability")
    )


def binomial(params: DataFrame) -> DataFrame:
    """k = 0..trials successes at probability ``p``."""
    k = F.explode(F.sequence(F.lit(0), F.col("trials"))).alias("k")
    p, n = F.col("p"), F.col("trials")
    mass = choose(n, F.col("k")) * F.pow(p, F.col("k")) * F.pow(1 - p, n - F.col("k"))
    return params.select("*", k).select(*params.columns, "k", mass.alias("probability"))


def poisson(params: DataFrame) -> DataFrame:
    """k = 0..kmax events at rate ``lam``."""
    k = F.explode(F.sequence(F.lit(0), F.col("kmax"))).alias("k")
    mass = F.exp(-F.col("lam")) * F.pow("lam", F.col("k")) / factorial_of(F.col("k"))
    return params.select("*", k).select(*params.columns, "k", mass.alias("probability"))


def empirical(baskets: DataFrame) -> DataFrame:
    """Share of the draws (not of all numbers) that hold a number."""
    counts = frequency(baskets.select("lottery_id", F.explode("numbers").alias("number")))
    joined = counts.join(draw_scope(baskets).select("lottery_id", "draw_count"), "lottery_id")
    return joined.select("lottery_id", "number", (F.col("n") / F.col("draw_count")).alias("value"))


def pick_column(keys: list[str], seed: int, low, high, count) -> Column:
    """``count`` distinct numbers of [low, high], the lowest hashes of the row's keys first."""
    scored = F.transform(
        F.sequence(low, high),
        lambda n: F.struct(
            hash_text(F.lit(seed), *[F.col(k) for k in keys], n).alias("h"), n.alias("n")
        ),
    )
    return F.slice(F.sort_array(scored), F.lit(1), count)["n"]


def monte_carlo(sims: DataFrame, lottery: DataFrame, seed: int) -> DataFrame:
    """Share of seeded selections without replacement that hold each number.

    ``sims`` has one row (lottery_id, sim) per simulation. A selection is made inside its row,
    so only the counted numbers are shuffled.
    """
    rules = lottery.select("lottery_id", "min_number", "max_number", "numbers_to_select")
    ruled = with_dimension(spread(sims, "lottery_id", "sim"), rules, "lottery_id")
    picks = pick_column(
        ["lottery_id", "sim"],
        seed,
        F.col("min_number"),
        F.col("max_number"),
        F.col("numbers_to_select"),
    )
    # Exploded in place: a named array column would be evaluated again by an inferred filter.
    hits = (
        ruled.select("lottery_id", F.explode(picks).alias("number"))
        .groupBy("lottery_id", "number")
        .agg(F.count("*").alias("n"))
    )
    total = sims.groupBy("lottery_id").agg(F.count("*").alias("sims"))
    universe = rules.select(
        "lottery_id", F.explode(F.sequence("min_number", "max_number")).alias("number")
    )
    return (
        universe.join(total, "lottery_id")
        .join(hits, ["lottery_id", "number"], "left")
        .select(
            "lottery_id",
            "number",
            (F.coalesce(F.col("n"), F.lit(0)) / F.col("sims")).alias("value"),
        )
    )


def nearest_rank_percentile(
    values: DataFrame, by: list[str], value: str, points=(50, 90, 99), scale: int = 100
) -> DataFrame:
    """Exact nearest-rank percentiles of a value with fixed decimals.

    Equal values are counted first; the rank is a running count over the scaled value, chunked
    like a series. Nothing is collected per group.
    """
    keyed = values.where(F.col(value).isNotNull()).select(
        *by, F.round(F.col(value) * scale).cast("long").alias("_v")
    )
    counted = keyed.groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    ranked = running(counted, by, "_v", {"_upto": ("sum", F.col("_n"))})
    total = counted.groupBy(*by).agg(F.sum("_n").alias("_total"))
    wanted = F.explode(F.array(*[F.lit(p) for p in points])).alias("percentile")
    targets = total.select(*by, "_total", wanted).withColumn(
        "_rank", F.greatest(F.ceil(F.col("percentile") * F.col("_total") / 100), F.lit(1))
    )
    reached = ranked.join(targets, by).where(F.col("_upto") >= F.col("_rank"))
    return reached.groupBy(*by, "percentile").agg((F.min("_v") / scale).alias("value"))


def bayes_posterior(prior: DataFrame, likelihood: DataFrame) -> DataFrame:
    """Normalised prior x likelihood over the union of subjects; all zero gives no rows."""
    p = prior.select("lottery_id", "number", F.col("value").alias("_p"))
    q = likelihood.select("lottery_id", "number", F.col("value").alias("_q"))
    both = p.join(q, ["lottery_id", "number"], "full")
    mass = F.coalesce(F.col("_p"), F.lit(0.0)) * F.coalesce(F.col("_q"), F.lit(0.0))
    joint = both.select("lottery_id", "number", mass.alias("_m"))
    whole = F.sum("_m").over(W.partitionBy("lottery_id"))
    return (
        joint.withColumn("_t", whole)
        .where(F.col("_t") != 0)
        .select("lottery_id", "number", (F.col("_m") / F.col("_t")).alias("value"))
    )


def conditional(baskets: DataFrame, window: int = 20, by_universe: bool = False) -> DataFrame:
    """Share of the newest ``window`` draws holding a number.

    ``by_universe`` divides by min(distinct numbers ever seen, window) instead.
    """
    recent = last_draws(baskets.select("lottery_id", "draw_number", "numbers"), window)
    counts = frequency(recent.select("lottery_id", F.explode("numbers").alias("number")))
    if by_universe:
        seen = baskets.select("lottery_id", F.explode("numbers").alias("number"))
        size = seen.groupBy("lottery_id").agg(F.count_distinct("number").alias("_d"))
        size = size.select("lottery_id", F.least("_d", F.lit(window)).alias("_d"))
    else:
        size = recent.groupBy("lottery_id").agg(F.count("*").alias("_d"))
    return counts.join(size, "lottery_id").select(
        "lottery_id", "number", (F.col("n") / F.col("_d")).alias("value")
    )


@register_model("empirical")
def _empirical(baskets: DataFrame, lottery: DataFrame) -> DataFrame:
    return empirical(baskets).withColumnRenamed("number", "subject")


@register_model("conditional")
def _conditional(baskets: DataFrame, lottery: DataFrame) -> DataFrame:
    return conditional(baskets).withColumnRenamed("number", "subject")


@register_model("bayes")
def _bayes(baskets: DataFrame, lottery: DataFrame) -> DataFrame:
    posterior = bayes_posterior(empirical(baskets), conditional(baskets))
    return posterior.withColumnRenamed("number", "subject")


@register_model("monte_carlo")
def _monte_carlo(baskets: DataFrame, lottery: DataFrame) -> DataFrame:
    sims = baskets.select("lottery_id", F.col("draw_number").alias("sim"))
    shares = monte_carlo(sims, lottery, seed=7)
    points = nearest_rank_percentile(shares, ["lottery_id"], "value", scale=10**8)
    return shares.select(
        "lottery_id", F.concat(F.lit("prob_"), "number").alias("subject"), "value"
    ).unionByName(
        points.select(
            "lottery_id", F.concat(F.lit("p"), "percentile").alias("subject"), "value"
        )
    )


@register_model("hypergeometric")
def _hypergeometric(baskets: DataFrame, lottery: DataFrame) -> DataFrame:
    pool = F.col("max_number") - F.col("min_number") + 1
    params = lottery.select(
        "lottery_id",
        pool.alias("pool"),
        F.col("numbers_to_select").alias("picks"),
        F.col("numbers_to_select").alias("good"),
    )
    return hypergeometric(params).select(
        "lottery_id", F.col("k").alias("subject"), F.col("probability").alias("value")
    )


def prob_values(baskets: DataFrame, lottery: DataFrame, models: list[str] | None = None):
    """All registered models as (lottery_id, model_id, subject, value)."""
    out = None
    for name in models or MODELS:
        rows = MODELS[name](baskets, lottery).select(
            "lottery_id",
            F.lit(name).alias("model_id"),
            F.col("subject").cast("string").alias("subject"),
            rounded("value", 8).alias("value"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def number_distribution(values: DataFrame, model_id: str = "empirical") -> DataFrame:
    """Number → probability of one model; subjects that are no integers are left out."""
    number = F.col("subject").try_cast("int")
    return values.where((F.col("model_id") == model_id) & number.isNotNull()).select(
        "lottery_id", number.alias("number"), F.col("value").alias("probability")
    )
