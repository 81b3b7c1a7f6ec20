"""Frequencies, gaps, averages, entropy and the views built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urnframe.functions.columns import rounded
from urnframe.operators.scan import last_draws
from urnframe.plans.series import dense_index, running
from urnframe.session import checkpoint_frame

NUMBER = ["lottery_id", "number"]


def frequency(numbers: DataFrame) -> DataFrame:
    return numbers.groupBy(*NUMBER).agg(F.count("*").alias("n"))


def positional_frequency(numbers: DataFrame) -> DataFrame:
    return numbers.groupBy(*NUMBER, "position").agg(F.count("*").alias("n"))


def _appearances(baskets: DataFrame) -> DataFrame:
    # One row per draw, written once: the scan over the numbers passes over it twice.
    indexed = checkpoint_frame(
        dense_index(
            baskets.select("lottery_id", "draw_number", "numbers"), ["lottery_id"], "draw_number"
        )
    )
    return indexed.select("lottery_id", "draw_number", "idx", F.explode("numbers").alias("number"))


def _with_previous(baskets: DataFrame) -> DataFrame:
    seen = {"prev_idx": ("last", F.col("idx"))}
    return running(_appearances(baskets), NUMBER, "idx", seen, exclusive=True)


def gap_series(baskets: DataFrame) -> DataFrame:
    """Distance in draws between consecutive appearances of a number."""
    return (
        _with_previous(baskets)
        .where(F.col("prev_idx").isNotNull())
        .select(*NUMBER, "draw_number", (F.col("idx") - F.col("prev_idx")).alias("gap"))
    )


def gap_summary(baskets: DataFrame) -> DataFrame:
    """Count, min, max and mean gap; a number seen once has count 0 and nulls."""
    gap = F.col("idx") - F.col("prev_idx")
    return (
        _with_previous(baskets)
        .groupBy(*NUMBER)
        .agg(
            F.count(gap).alias("gap_count"),
            F.min(gap).alias("gap_min"),
            F.max(gap).alias("gap_max"),
            rounded(F.avg(gap)).alias("gap_avg"),
        )
    )


def null_aware_average(baskets: DataFrame) -> DataFrame:
    """Mean over the non-null values of jackpot and winners; all null gives null."""
    wide = baskets.groupBy("lottery_id").agg(
        F.avg("jackpot").alias("jackpot_mean"),
        F.count("jackpot").alias("jackpot_n"),
        F.avg("winners").alias("winners_mean"),
        F.count("winners").alias("winners_n"),
    )
    series = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(s).alias("series"),
                    rounded(f"{s}_mean", 4).alias("mean"),
                    F.col(f"{s}_n").alias("non_null"),
                )
                for s in ("jackpot", "winners")
            ]
        )
    )
    return wide.select("lottery_id", series.alias("s")).select("lottery_id", "s.*")


def entropy_base2(counts: DataFrame, lottery: DataFrame) -> DataFrame:
    """Entropy in bits over the lottery's numbers; the total includes numbers out of range."""
    whole = W.partitionBy("lottery_id")  # at most the universe per lottery
    share = counts.select(
        "lottery_id", "number", (F.col("n") / F.sum("n").over(whole)).alias("p")
    )
    # A lottery without counts still gets its row, with entropy 0.
    empty = lottery.select("lottery_id", F.lit(None).cast("int").alias("number"), F.lit(0.0).alias("p"))
    rules = lottery.select("lottery_id", "min_number", "max_number")
    inside = F.col("number").between(F.col("min_number"), F.col("max_number"))
    bits = F.sum(F.when(inside & (F.col("p") > 0), -F.col("p") * F.log2("p")))
    return (
        share.unionByName(empty)
        .join(rules, "lottery_id")
        .groupBy("lottery_id")
        .agg(rounded(F.coalesce(bits, F.lit(0.0))).alias("entropy"))
    )


def draw_scope(baskets: DataFrame) -> DataFrame:
    return baskets.groupBy("lottery_id").agg(
        F.count("*").alias("draw_count"),
        F.min("draw_number").alias("draws_from"),
        F.max("draw_number").alias("draws_to"),
    )


def stats_snapshot(baskets: DataFrame, lottery: DataFrame) -> DataFrame:
    """All statistics of every lottery as one long table (section, subject, metric, value)."""
    numbers = baskets.select(
        "lottery_id", F.posexplode("numbers").alias("pos", "number")
    ).withColumn("position", F.col("pos") + 1)
    by_position = positional_frequency(numbers)
    # Frequencies are rolled up from the (45 x positions) table, not from the numbers again.
    counts = by_position.groupBy(*NUMBER).agg(F.sum("n").alias("n"))

    def rows(df: DataFrame, section: str, subject, metrics: dict[str, str]) -> DataFrame:
        pairs = F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value"))
                    for m, c in metrics.items()
                ]
            )
        )
        return df.select(
            "lottery_id", F.lit(section).alias("section"), subject.alias("subject"), pairs.alias("m")
        ).select("lottery_id", "section", "subject", "m.metric", "m.value")

    number = F.col("number").cast("string")
    parts = [
        rows(counts, "frequency", number, {"count": "n"}),
        rows(
            by_position,
            "position",
            F.concat_ws("@", "number", "position"),
            {"count": "n"},
        ),
        rows(
            gap_summary(baskets),
            "gap",
            number,
            {"count": "gap_count", "min": "gap_min", "max": "gap_max", "avg": "gap_avg"},
        ),
        rows(
            null_aware_average(baskets),
            "average",
            F.col("series"),
            {"mean": "mean", "non_null": "non_null"},
        ),
        rows(entropy_base2(counts, lottery), "scalar", F.lit("entropy"), {"value": "entropy"}),
        rows(
            draw_scope(baskets),
            "scope",
            F.lit("draws"),
            {"draw_count": "draw_count", "draws_from": "draws_from", "draws_to": "draws_to"},
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def last_n_counts(baskets: DataFrame, n: int) -> DataFrame:
    """Counts per number over the newest ``n`` draws."""
    recent = last_draws(baskets.select("lottery_id", "draw_number", "numbers"), n)
    return frequency(recent.select("lottery_id", F.explode("numbers").alias("number")))


def rolling_trend(baskets: DataFrame, hot: DataFrame, n: int = 20, k: int = 5) -> DataFrame:
    """Running count of each hot number over the newest ``n`` draws, one column for each of ``k`` ranks."""
    recent = last_draws(baskets.select("lottery_id", "draw_number", "numbers"), n)
    ordered = W.partitionBy("lottery_id", "rank").orderBy("draw_number")
    hits = F.array_contains(F.col("numbers"), F.col("number")).cast("long")
    grid = recent.join(hot.select("lottery_id", "number", "rank"), "lottery_id")
    counted = grid.withColumn("c", F.sum(hits).over(ordered.rowsBetween(W.unboundedPreceding, 0)))
    ranks = range(1, k + 1)
    return counted.groupBy("lottery_id", "draw_number").agg(
        *[F.max(F.when(F.col("rank") == r, F.col("c"))).alias(f"hot_{r}") for r in ranks]
    )


def hottest_coldest(counts: DataFrame) -> DataFrame:
    """Most and least frequent number; ties go to the lowest number."""
    return counts.groupBy("lottery_id").agg(
        F.max_by("number", F.struct("n", -F.col("number"))).alias("hottest"),
        F.max("n").alias("max_count"),
        F.min_by("number", F.struct("n", "number")).alias("coldest"),
        F.min("n").alias("min_count"),
    )


def gap_extremes(gaps: DataFrame) -> DataFrame:
    """Numbers with the largest and the smallest mean gap, nulls left out."""
    known = gaps.where(F.col("gap_avg").isNotNull())
    return known.groupBy("lottery_id").agg(
        F.max_by("number", F.struct("gap_avg", -F.col("number"))).alias("widest"),
        F.max("gap_avg").alias("widest_avg"),
        F.min_by("number", F.struct("gap_avg", "number")).alias("tightest"),
        F.min("gap_avg").alias("tightest_avg"),
    )


def dense_heatmap(pairs: DataFrame, lottery: DataFrame) -> DataFrame:
    """Every cell of the symmetric number grid with null holes and the global range."""
    axis = F.sequence("min_number", "max_number")
    grid = lottery.select("lottery_id", axis.alias("_axis")).select(
        "lottery_id", "_axis", F.explode("_axis").alias("row")
    )
    grid = grid.select("lottery_id", "row", F.explode("_axis").alias("col"))
    both = pairs.select("lottery_id", F.col("a").alias("row"), F.col("b").alias("col"), "weight")
    both = both.unionByName(
        pairs.select("lottery_id", F.col("b").alias("row"), F.col("a").alias("col"), "weight")
    )
    whole = W.partitionBy("lottery_id")
    return grid.join(both, ["lottery_id", "row", "col"], "left").select(
        "lottery_id",
        "row",
        "col",
        "weight",
        F.min("weight").over(whole).alias("min_weight"),
        F.max("weight").over(whole).alias("max_weight"),
    )
