"""Cross-model ranking: normalise, score, rank, select."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urnframe.plans.series import total_rank

# Fixed set of metrics that are comparable across engines, and the one where less is better.
COMMON_METRICS = ["hit_rate", "average_matches", "consistency_score", "precision", "recall", "f1_score"]
LESS_IS_BETTER = "consistency_score"

# Fixed default weights.
WEIGHTS = {
    "hit_rate": 0.3,
    "average_matches": 0.3,
    "consistency_score": 0.2,
    "precision": 0.1,
    "recall": 0.1,
}

# Fixed short names of the engines.
PREFIX = {"backtesting": "bt", "ml": "ml", "dl": "dl", "optimization": "opt"}


def model_metrics(merged: DataFrame, headers: DataFrame) -> DataFrame:
    """Metrics of the active snapshots with model ids like ``bt-static-3``.

    ``headers`` has (engine_type, snapshot_id, status). ``f1`` is read as ``f1_score``;
    metrics that are not common to the engines are left out.
    """
    active = headers.where(F.col("status") == "active").select("engine_type", "snapshot_id")
    prefix = F.lit(None).cast("string")
    for engine, short in PREFIX.items():
        prefix = F.when(F.col("engine_type") == engine, F.lit(short)).otherwise(prefix)
    name = F.when(F.col("metric_name") == "f1", F.lit("f1_score")).otherwise(F.col("metric_name"))
    return (
        merged.join(active, ["engine_type", "snapshot_id"], "left_semi")
        .select(
            "lottery_id",
            "engine_type",
            F.concat_ws("-", prefix, "model_id", "snapshot_id").alias("model_id"),
            name.alias("metric_name"),
            "value",
        )
        .where(F.col("metric_name").isin(COMMON_METRICS))
    )


def context_vector(headers: DataFrame) -> DataFrame:
    """Draw range, cut and window of the newest active snapshot per lottery and engine.

    Backtests and searches carry no draw range: 0 and 0, no cut, no window.
    """
    ranged = F.col("engine_type").isin("ml", "dl")
    newest = F.max_by(
        F.struct("draws_from", "draws_to", "cut", "window"), F.struct("created_at", "snapshot_id")
    )
    active = headers.where(F.col("status") == "active")
    picked = active.groupBy("lottery_id", "engine_type").agg(newest.alias("s"))
    return picked.select(
        "lottery_id",
        "engine_type",
        F.when(ranged, F.col("s.draws_from")).otherwise(0).alias("draws_from"),
        F.when(ranged, F.col("s.draws_to")).otherwise(0).alias("draws_to"),
        F.when(ranged, F.col("s.cut")).alias("cut"),
        F.when(F.col("engine_type") == "dl", F.col("s.window")).alias("window"),
    )


def normalize_metrics(metrics: DataFrame) -> DataFrame:
    """Min-max per lottery, engine and metric in wide form; missing counts as 0.

    One model alone gets 1, equal values get 0, and the deviation is turned round. The ranges
    come from a combining aggregate, so a big engine is no hot group.
    """
    scope = ["lottery_id", "engine_type"]
    ranges = metrics.groupBy(*scope, "metric_name").agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count("value").alias("_n")
    )
    lo, hi, v = F.col("_lo"), F.col("_hi"), F.col("value")
    inverted = F.col("metric_name") == LESS_IS_BETTER
    scaled = F.when(inverted, (hi - v) / (hi - lo)).otherwise((v - lo) / (hi - lo))
    value = F.when(F.col("_n") == 1, F.lit(1.0)).when(hi == lo, F.lit(0.0)).otherwise(scaled)
    rows = metrics.join(ranges, [*scope, "metric_name"]).select(
        *scope, "model_id", "metric_name", value.alias("value")
    )
    wide = rows.groupBy(*scope, "model_id").pivot("metric_name", COMMON_METRICS)
    return wide.agg(F.first("value")).na.fill(0.0)


def composite_score(wide: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Weighted sum of the normalised metrics."""
    weights = dict(weights or WEIGHTS)
    if sum(weights.values()) == 0:
        raise ValueError("weights sum to zero")
    score = F.lit(0.0)
    for name, weight in weights.items():
        if name in wide.columns:
            score = score + F.col(name) * weight
    return wide.withColumn("score", F.round(score, 8))


def rank_models(scored: DataFrame) -> DataFrame:
    """Ranks per lottery by score; ties keep the order of ``input_order`` (a unique integer)."""
    keyed = scored.withColumn("_k", -F.round(F.col("score") * 10**8).cast("long"))
    return total_rank(keyed, ["lottery_id"], "_k", "input_order").drop("_k")


def select_top_k(ranked: DataFrame, k: int, min_score: float = 0.0) -> DataFrame:
    """The best ``k`` of each lottery at or above ``min_score``, with consecutive ranks."""
    if not 1 <= k <= 20:
        raise ValueError("top_k is 1..20")
    kept = ranked.where(F.col("score") >= min_score).withColumnRenamed("rank", "_old")
    order = W.partitionBy("lottery_id").orderBy("_old")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.withColumn("rank", F.col("rank").cast("long")).drop("_old")


def list_versions(headers: DataFrame, lottery_id: int, context: str) -> DataFrame:
    """Ranking or selection headers of one lottery and context, newest version first."""
    kept = (F.col("lottery_id") == lottery_id) & (F.col("context") == context)
    return headers.where(kept).orderBy(F.desc("version"))
