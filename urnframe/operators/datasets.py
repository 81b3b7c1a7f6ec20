"""Versioned lists of draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urnframe.operators.identity import additive_digest
from urnframe.functions.columns import row_digest
from urnframe.plans.series import dense_index


def select_dataset(draws: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """Visible draws in an inclusive date window."""
    day = F.col("draw_date")
    window = day.between(F.lit(date_from).cast("date"), F.lit(date_to).cast("date"))
    return draws.where(~F.col("is_deleted") & window).select(
        "lottery_id", "draw_number", "draw_date"
    )


def dedupe_keep_first(ids: DataFrame, key: str, seq: str) -> DataFrame:
    """Distinct ids in first-seen order with their 0-based place."""
    first = ids.groupBy(key).agg(F.min(seq).alias("first_seq"))
    return dense_index(first, [], "first_seq", out="composition_id")


def compose(selection: DataFrame) -> DataFrame:
    """Number the draws of a selection per lottery in id order."""
    return dense_index(selection, ["lottery_id"], "draw_number", out="composition_id")


def dataset_checksum(members: DataFrame, filters: str, generator: str) -> DataFrame:
    """Digest of filters, generator version and the ordered ids, per lottery."""
    digests = members.select(
        "lottery_id",
        row_digest(
            F.lit(filters), F.lit(generator), F.col("composition_id"), F.col("draw_number")
        ).alias("digest"),
    )
    return additive_digest(digests, ["lottery_id"])


def draws_for_dataset(members: DataFrame, draws: DataFrame) -> DataFrame:
    """Member draws in composition order."""
    keys = ["lottery_id", "draw_number"]
    joined = members.select(*keys, "composition_id").join(
        draws.select(*keys, "draw_date", "jackpot"), keys
    )
    return joined.orderBy("lottery_id", "composition_id")
