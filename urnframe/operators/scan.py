"""Scans that turn draw and number tables into ordered baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["lottery_id", "draw_number"]


def scan_draws(draws: DataFrame, draw_numbers: DataFrame, after: int | None = None) -> DataFrame:
    """Visible draws with ``numbers`` in position order; draws without numbers drop out.

    ``after`` keeps only later draws; it is filtered on both inputs before they are joined.
    """
    visible = draws.where(~F.col("is_deleted")).drop("is_deleted")
    if after is not None:
        visible = visible.where(F.col("draw_number") > after)
        draw_numbers = draw_numbers.where(F.col("draw_number") > after)
    ordered = F.sort_array(F.collect_list(F.struct("position", "number")))["number"]
    picked = draw_numbers.groupBy(*KEY).agg(ordered.alias("numbers"))
    return visible.join(picked, KEY)


def scan_delta(draws: DataFrame, draw_numbers: DataFrame, after: int) -> DataFrame:
    return scan_draws(draws, draw_numbers, after=after)


def explode_numbers(baskets: DataFrame) -> DataFrame:
    """One row per (draw, position), positions from 1."""
    return baskets.select(*KEY, F.posexplode("numbers").alias("pos", "number")).select(
        *KEY, (F.col("pos") + 1).alias("position"), "number"
    )


def read_backtest_draws(draws: DataFrame, draw_numbers: DataFrame, supers: DataFrame) -> DataFrame:
    """Visible draws with sorted numbers and the optional super number, for date order."""
    baskets = scan_draws(draws.drop("super_number"), draw_numbers)
    return baskets.join(supers, KEY, "left").select(
        "lottery_id",
        "draw_number",
        "draw_date",
        F.sort_array("numbers").alias("numbers"),
        "super_number",
    )


def last_draws(baskets: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` draws of every lottery.

    Spark keeps only ``n`` rows per lottery and task before the shuffle (window group limit).
    """
    newest = W.partitionBy("lottery_id").orderBy(F.desc("draw_number"))
    return baskets.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n).drop("_r")


def visible_draws(edits: DataFrame, draws: DataFrame) -> DataFrame:
    """Apply a soft-delete/restore log: the flag of the highest ``seq`` per draw wins."""
    latest = edits.groupBy(*KEY).agg(F.max_by("is_deleted", "seq").alias("_flag"))
    return (
        draws.join(latest, KEY, "left")
        .where(~F.coalesce(F.col("_flag"), F.col("is_deleted")))
        .drop("_flag", "is_deleted")
    )
