"""Structured Streaming forms of the import, the counts and the gap state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urnframe.session import checkpoint_frame
from urnframe.sources.importing import stream_files

NUMBER = ["lottery_id", "number"]
GAP_BITS = 16  # draw numbers of a chunk of gap summaries


def run_to_end(writer, checkpoint: str) -> None:
    """Process everything that is there and stop; a restart continues from the checkpoint."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def batches_to(path: str) -> Callable[[DataFrame, int], None]:
    """Sink writing each micro-batch to its own folder.

    A batch that is run again after a failure overwrites its folder, so results count once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest version of every key from an update-mode sink of :func:`batches_to`."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*values), "batch")
    return rows.groupBy(*keys).agg(newest.alias("_v")).select(*keys, "_v.*")


# --- import ----------------------------------------------------------------

stream_import = stream_files  # one import for batch jobs and streams, see sources.importing


# --- counts and dedupe -----------------------------------------------------


def stream_dedupe(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """First arrival of a key within the watermark; later copies are dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def stream_frequency(numbers: DataFrame) -> DataFrame:
    """Running counts per number, for update mode."""
    return numbers.groupBy(*NUMBER).agg(F.count("*").alias("n"))


def windowed_draws(events: DataFrame, time: str, by: str, item: str, window: Column) -> DataFrame:
    """Baskets of distinct items per key and time window; the item universe bounds a basket."""
    return events.groupBy(by, window.alias("w")).agg(
        F.sort_array(F.collect_set(item)).alias("items")
    ).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "items")


# --- gap state -------------------------------------------------------------


def chunk_gaps(rows: DataFrame) -> DataFrame:
    """Gap summary of every (lottery, number, chunk): first and last draw, and count, min, max and sum of gaps.

    Summaries of neighbouring chunks merge by the gap between them (:func:`merged_gaps`).
    """
    keys = [*NUMBER, "chunk"]
    order = W.partitionBy(*keys).orderBy("draw_number")  # at most the draws of a chunk
    gap = F.col("draw_number") - F.lag("draw_number").over(order)
    return rows.select(*keys, "draw_number", gap.alias("gap")).groupBy(*keys).agg(
        F.min("draw_number").alias("first_seen"), F.max("draw_number").alias("last_seen"), F.count("gap").alias("gap_count"),
        F.min("gap").alias("gap_min"), F.max("gap").alias("gap_max"), F.coalesce(F.sum("gap"), F.lit(0)).alias("gap_sum"),
    )


def merged_gaps(chunks: DataFrame) -> DataFrame:
    """Last draw, count, min, max and sum of gaps (in draw numbers) per number, over its chunks in order."""
    order = W.partitionBy(*NUMBER).orderBy("chunk")  # one row for each 2**GAP_BITS draw numbers
    bridge = F.col("first_seen") - F.lag("last_seen").over(order)
    bridged = chunks.select("*", bridge.alias("bridge"))
    return bridged.groupBy(*NUMBER).agg(
        F.max("last_seen").alias("last_seen"),
        (F.sum("gap_count") + F.count("bridge")).alias("gap_count"),
        F.least(F.min("gap_min"), F.min("bridge")).alias("gap_min"),
        F.greatest(F.max("gap_max"), F.max("bridge")).alias("gap_max"),
        (F.sum("gap_sum") + F.coalesce(F.sum("bridge"), F.lit(0))).alias("gap_sum"),
    )


def gap_batches(root: str) -> Callable[[DataFrame, int], None]:
    """Sink that keeps the gap summaries of (lottery, number, draw) rows under ``root``, late rows included.

    Each micro-batch appends its rows, by chunk of draw numbers, and summarises again the chunks that it
    touches: in order that is the newest one, a late row touches its own. Repeated rows count once.
    """
    rows_at, gaps_at = f"{root}/rows", f"{root}/gaps"
    schema = "lottery_id int, number int, draw_number bigint, batch bigint, chunk bigint"

    def load(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = checkpoint_frame(
            batch.select(*NUMBER, "draw_number", F.shiftright(F.col("draw_number").cast("long"), GAP_BITS).alias("chunk")).distinct()
        )
        own.write.mode("overwrite").partitionBy("chunk").parquet(f"{rows_at}/batch={batch_id}")
        touched = own.select(*NUMBER, "chunk").distinct()
        known = spark.read.schema(schema).parquet(rows_at).where(F.col("batch") <= batch_id)
        whole = known.join(touched, [*NUMBER, "chunk"], "left_semi").select(*NUMBER, "chunk", "draw_number").distinct()
        chunk_gaps(whole).write.mode("overwrite").parquet(f"{gaps_at}/batch={batch_id}")

    return load


def gap_state(spark: SparkSession, root: str) -> DataFrame:
    """The gap summary per number from a sink of :func:`gap_batches`."""
    return merged_gaps(latest(spark, f"{root}/gaps", [*NUMBER, "chunk"]))


# --- delta fold ------------------------------------------------------------


def accumulators(baskets: DataFrame) -> DataFrame:
    """Mergeable counts per (lottery, number, position)."""
    rows = baskets.select("lottery_id", F.posexplode("numbers").alias("pos", "number"))
    return rows.groupBy(*NUMBER, (F.col("pos") + 1).alias("position")).agg(F.count("*").alias("n"))


def fold_delta(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Old accumulators plus those of new draws equal a full rebuild."""
    keys = [*NUMBER, "position"]
    return old.unionByName(delta).groupBy(*keys).agg(F.sum("n").alias("n"))
