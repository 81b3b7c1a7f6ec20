"""Versioned snapshots, manifests and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed columns of the run export.
RUN_COLUMNS = ["run_label", "engine_type", "model_id", "metric_name", "value"]


def snapshot_path(root: str, scope: str, version: int) -> str:
    return f"{root.rstrip('/')}/scope={scope}/version={version}"


def write_snapshot(df: DataFrame, root: str, scope: str, version: int, key: Sequence[str]) -> str:
    """Publish an immutable version; rows are range-partitioned and sorted by ``key``.

    An existing version is an error, so a retried job can never mix two versions.
    """
    path = snapshot_path(root, scope, version)
    ordered = df.repartitionByRange(*key).sortWithinPartitions(*key)
    ordered.write.mode("errorifexists").parquet(path)
    return path


def read_snapshot(spark: SparkSession, root: str, scope: str, version: int) -> DataFrame:
    return spark.read.parquet(snapshot_path(root, scope, version))


def create_dataset(members: DataFrame, root: str, name: str, version: int, manifest: DataFrame) -> str:
    """Write a locked dataset: its member rows, then the one-row manifest that makes it valid."""
    path = write_snapshot(members, root, name, version, ["lottery_id", "composition_id"])
    manifest.write.mode("errorifexists").json(f"{path}_manifest")
    return path


def export_csv(df: DataFrame, path: str, columns: Sequence[str] = RUN_COLUMNS) -> None:
    df.select(*columns).write.mode("errorifexists").option("header", True).csv(path)


def export_json(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """One JSON object per line with the columns in the given order."""
    cols = list(columns or df.columns)
    df.select(F.to_json(F.struct(*cols)).alias("value")).write.mode("errorifexists").text(path)


def quarantine_errors(validated: DataFrame, path: str | None = None) -> DataFrame:
    """One row per validation error with the raw line; written to ``path`` when given."""
    raw = F.concat_ws(
        ",", "draw_number", "draw_date", "numbers", "super_number", "jackpot", "winners"
    )
    rows = validated.select(
        "lottery_id",
        "row_number",
        "draw_number",
        raw.alias("raw_row"),
        # The outer form validates once; a plain explode would add a filter on the error list.
        F.posexplode_outer("errors").alias("error_no", "e"),
    ).where(F.col("e").isNotNull()).select(
        "lottery_id",
        "row_number",
        "draw_number",
        (F.col("error_no") + 1).alias("error_no"),
        F.col("e.code").alias("error_code"),
        F.col("e.message").alias("message"),
        "raw_row",
    )
    if path is not None:
        rows.write.mode("append").parquet(path)
    return rows
