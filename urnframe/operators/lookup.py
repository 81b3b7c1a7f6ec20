"""Filters, ordering, paging and top-k reads."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def list_draws(
    draws: DataFrame,
    lottery: DataFrame,
    code: str | None = None,
    date_from: date | str | None = None,
    date_to: date | str | None = None,
    deleted: bool = False,
) -> DataFrame:
    """Draws of one lottery code in an inclusive date range."""
    kept = draws.where(F.col("is_deleted") == F.lit(deleted))
    if date_from is not None:
        kept = kept.where(F.col("draw_date") >= F.lit(str(date_from)).cast("date"))
    if date_to is not None:
        kept = kept.where(F.col("draw_date") <= F.lit(str(date_to)).cast("date"))
    wanted = lottery.select("lottery_id", "code")
    if code is not None:
        wanted = wanted.where(F.col("code") == code)
    return kept.join(wanted, "lottery_id")


def page(df: DataFrame, order: Sequence[Column | str], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows; a bounded top-k, not a full sort."""
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_draws(draws: DataFrame, number: int, size: int, descending: bool = False) -> DataFrame:
    by_date = F.desc("draw_date") if descending else F.asc("draw_date")
    return page(draws, [by_date, "draw_number"], number, size)


def page_table(df: DataFrame, key: str, number: int, size: int) -> DataFrame:
    return page(df, [key], number, size)


def find_draw(draws: DataFrame, lottery_id: int, draw_number: int) -> DataFrame:
    return draws.where((F.col("lottery_id") == lottery_id) & (F.col("draw_number") == draw_number))


def first_rows(df: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    """Rows in order; ``n`` = 0 means all of them."""
    ordered = df.orderBy(*order)
    return ordered.limit(n) if n > 0 else ordered


def read_long(
    df: DataFrame, order: Sequence[Column | str], n: int = 0, **equals: object
) -> DataFrame:
    """Payload rows matching every given column value, in a fixed order."""
    for name, value in equals.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return first_rows(df, n, order)


def read_features(df: DataFrame, feature_id: str | None = None, n: int = 0) -> DataFrame:
    return read_long(df, ["feature_id", "lottery_id", "draw_number"], n, feature_id=feature_id)


def read_prob_values(df: DataFrame, model_id: str | None = None, subject: str | None = None):
    return read_long(
        df, ["lottery_id", "model_id", "subject"], model_id=model_id, subject=subject
    )


def read_metrics(df: DataFrame, model_id: str | None = None) -> DataFrame:
    return read_long(df, ["model_id", "number", "metric_name"], model_id=model_id)


def read_graph_values(df: DataFrame, metric_type: str | None = None, subject: str | None = None):
    return read_long(
        df, ["lottery_id", "metric_type", "subject"], metric_type=metric_type, subject=subject
    )


def read_search_results(df: DataFrame, snapshot_id: int, target: str | None = None) -> DataFrame:
    return read_long(df, ["target_model", "eval_num"], snapshot_id=snapshot_id, target_model=target)


def hot_numbers(counts: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent numbers of every lottery; ties go to the lowest number."""
    return _per_lottery(counts, [F.desc("n"), F.asc("number")], k)


def cold_numbers(counts: DataFrame, k: int = 5) -> DataFrame:
    return _per_lottery(counts, [F.asc("n"), F.asc("number")], k)


def _per_lottery(counts: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("lottery_id").orderBy(*order))
    return counts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def top_metrics(metrics: DataFrame, n: int) -> DataFrame:
    order = [F.desc("value"), F.asc("model_id"), F.asc("metric_name"), F.asc("number")]
    return metrics.orderBy(*order).limit(n)


def numeric_only(df: DataFrame, column: str) -> DataFrame:
    """Drop rows whose text or number is not a finite number."""
    value = F.col(column).try_cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return df.where(finite).withColumn(column, value)


def sort_rows(df: DataFrame, column: str, direction: str, tie: str) -> DataFrame:
    """Order by a chosen column, nulls last, ``tie`` breaking equal values."""
    if direction not in ("asc", "desc"):
        raise ValueError("direction is asc or desc")
    main = F.col(column).asc_nulls_last() if direction == "asc" else F.col(column).desc_nulls_last()
    return df.orderBy(main, tie)
