"""Metrics of runs, comparisons of runs, versions of experiments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urnframe.functions.columns import rounded
from urnframe.plans.series import dense_index, running

RUN = ["lottery_id", "engine_type", "snapshot_id", "model_id"]


def engine_metrics(**engines: DataFrame) -> DataFrame:
    """Union of (lottery_id, snapshot_id, model_id, seq, metric_name, value), one per engine."""
    out = None
    for engine, rows in engines.items():
        part = rows.select(
            "lottery_id",
            F.lit(engine).alias("engine_type"),
            F.col("snapshot_id").cast("long").alias("snapshot_id"),
            "model_id",
            F.col("seq").cast("long").alias("seq"),
            "metric_name",
            F.col("value").cast("double").alias("value"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def merge_duplicate_metrics(metrics: DataFrame, fold: bool = False) -> DataFrame:
    """One value per run and metric name: the mean, or with ``fold`` the pairwise running mean.

    The pairwise fold (a + b) / 2 in ``seq`` order gives the i-th of n values the weight
    2**-(n - i + 1), the first 2**-(n - 1). Every value is weighed; a group is numbered in chunks of
    the whole number ``seq``, unique in its group, and summed, never gathered.
    """
    keys = [*RUN, "metric_name"]
    if not fold:
        return metrics.groupBy(*keys).agg(F.avg("value").alias("value"))
    placed = dense_index(metrics, keys, "seq", "_i")
    size = metrics.groupBy(*keys).agg(F.count("*").alias("_n"))
    power = F.when(F.col("_r") == F.col("_n"), F.col("_n") - 1).otherwise(F.col("_r"))
    recent = placed.join(size, keys).withColumn("_r", F.col("_n") - F.col("_i"))  # 1 is the newest
    weighed = recent.withColumn("_w", F.col("value") * F.pow(F.lit(2.0), -power))
    return weighed.groupBy(*keys).agg(F.sum("_w").alias("value"))


def require_runs(metrics: DataFrame, wanted: DataFrame) -> DataFrame:
    """Fail with fewer than two wanted runs or a run that has no metrics."""
    if wanted.limit(2).count() < 2:
        raise ValueError("a comparison needs at least two runs")
    missing = wanted.join(metrics, ["engine_type", "snapshot_id"], "left_anti")
    if not missing.isEmpty():
        raise ValueError("a run of the comparison does not exist")
    return metrics


def compare_runs(merged: DataFrame, wanted: DataFrame, names: Sequence[str]) -> DataFrame:
    """Runs by label with one column per metric name, names in order."""
    kept = merged.join(wanted, ["engine_type", "snapshot_id"], "left_semi")
    label = F.concat_ws("-", "engine_type", "snapshot_id", "model_id").alias("run_label")
    return (
        kept.select(label, "metric_name", "value")
        .groupBy("run_label")
        .pivot("metric_name", sorted(names))
        .agg(F.first("value"))
    )


def run_ids_key(comparisons: DataFrame, payload: str = "comparison_json") -> DataFrame:
    """Sorted run ids of a comparison as text; null where the JSON is unreadable."""
    parsed = F.from_json(payload, "struct<runs:array<struct<run_id:bigint>>>")
    ids = F.sort_array(parsed["runs"]["run_id"])
    key = F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")
    return comparisons.withColumn("run_ids_key", F.when(F.size(ids) > 0, key))


def find_comparison(wanted: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Lowest comparison id per (experiment, key); the stored key, else the one in the JSON."""
    keyed = run_ids_key(comparisons)
    key = F.coalesce("run_ids", "run_ids_key").alias("key")
    stored = keyed.select("experiment_id", "comparison_id", key)
    lowest = stored.groupBy("experiment_id", "key").agg(F.min("comparison_id").alias("comparison_id"))
    return wanted.join(lowest, ["experiment_id", "key"])


def best_run_per_metric(merged: DataFrame) -> DataFrame:
    """Best run per metric and its lead over the second; only the top two are sorted."""
    label = F.concat_ws("-", "engine_type", "snapshot_id", "model_id")
    rows = merged.select("metric_name", label.alias("run_label"), "value")
    order = W.partitionBy("metric_name").orderBy(F.desc("value"), "run_label")
    top = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 2)
    first = F.col("_r") == 1
    return (
        top.groupBy("metric_name")
        .agg(
            F.max(F.when(first, F.col("run_label"))).alias("best_run"),
            F.max(F.when(first, F.col("value"))).alias("best_value"),
            F.coalesce(F.max(F.when(~first, F.col("value"))), F.lit(0.0)).alias("_second"),
        )
        .select(
            "metric_name",
            "best_run",
            rounded("best_value").alias("best_value"),
            rounded(F.col("best_value") - F.col("_second")).alias("delta"),
        )
    )


def list_experiments(experiments: DataFrame, lottery_id: int, status: str | None = None):
    kept = experiments.where(F.col("lottery_id") == lottery_id)
    if status is not None:
        kept = kept.where(F.col("status") == status)
    return kept.orderBy(F.desc("created_at"), F.desc("experiment_id"))


def resolve_runs(runs: DataFrame, **headers: DataFrame) -> DataFrame:
    """Join runs to the header of their engine; the fingerprint column differs by engine.

    Each header has ``id`` and one of ``fingerprint`` or ``checksum``. A run without a header
    keeps null, so the caller can tell.
    """
    every = None
    for engine, header in headers.items():
        column = "fingerprint" if "fingerprint" in header.columns else "checksum"
        part = header.select(
            F.lit(engine).alias("engine_type"),
            F.col("id").alias("engine_snapshot_id"),
            F.col(column).alias("identity"),
        )
        every = part if every is None else every.unionByName(part)
    return runs.join(every, ["engine_type", "engine_snapshot_id"], "left")


def duplicate_names(experiments: DataFrame) -> DataFrame:
    """Names used by more than one active experiment of a lottery."""
    active = experiments.where(F.col("status") == "active")
    return active.groupBy("lottery_id", "name").agg(F.count("*").alias("n")).where(F.col("n") > 1)


def experiment_versions(log: DataFrame) -> DataFrame:
    """Version after every edit: +1 on a changed fingerprint; nothing after retirement counts."""
    ended = (
        log.where(F.col("status") == "retired")
        .groupBy("experiment_id")
        .agg(F.min("seq").alias("_end"))
    )
    live = (
        log.join(ended, "experiment_id", "left")
        .where(F.col("_end").isNull() | (F.col("seq") <= F.col("_end")))
        .select("experiment_id", "seq", "fingerprint")
    )
    by = ["experiment_id"]
    seen = running(live, by, "seq", {"_prev": ("last", F.col("fingerprint"))}, exclusive=True)
    changed = F.col("_prev").isNull() | (F.col("_prev") != F.col("fingerprint"))
    flagged = seen.select("experiment_id", "seq", "fingerprint", changed.cast("long").alias("_c"))
    return running(flagged, by, "seq", {"version": ("sum", F.col("_c"))}).select(
        "experiment_id", "seq", "version"
    )
