"""Session defaults and reliable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "urnframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC times.

    The master and the shuffle partition count are left to the cluster unless given here.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Small shuffles feed CPU-heavy rows (pairs, hashes): keep all cores busy on them.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "8k",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return os.path.join(tempfile.gettempdir(), f"urnframe-{spark.sparkContext.applicationId}")


def checkpoint_frame(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` at a written table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/frames/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``checkpoint_frame`` and its row count.

    The count comes from the footers of the written files, so an iterative job computes each
    round once. A lost executor re-reads the table; it never replays the rounds before it.
    """
    table = checkpoint_frame(df)
    return table, table.count()
