"""Joins against small per-lottery tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urnframe.session import checkpoint_frame

DIMENSION_ROWS = 50_000


def checked_broadcast(df: DataFrame, rows: int = DIMENSION_ROWS) -> DataFrame:
    """Broadcast ``df`` only when a count proves it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_dimension(
    big: DataFrame, small: DataFrame, on: str | Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join to a per-lottery table that is written once and broadcast when it is small.

    Without a broadcast Spark would deal the big side by its few lotteries: planned sizes of derived
    tables are guesses, and a big side that is shuffled already stays where it is. A table of more than
    ``DIMENSION_ROWS`` rows is merged, with hot lotteries split by Spark.
    """
    return big.join(checked_broadcast(checkpoint_frame(small)), on, how)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash slim rows over all cores before work that costs far more than moving them.

    Partitions sized by bytes would leave most cores idle: a row of two integers may stand for
    dozens of hashes.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    n = max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)
