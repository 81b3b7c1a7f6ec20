"""Catalog: streaming jobs, run to their end over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from urnframe.plans.catalog.ingestion import CHECKED, scratch
from urnframe.plans.registry import job
from urnframe.session import checkpoint_frame
from urnframe.sources import csv, importing
from urnframe.streaming import jobs

ARRIVALS = 3


def in_arrivals(t, rows, part, start):
    """Feed ``rows`` to a stream in several arrivals; ``part`` is the arrival of a row.

    ``start`` makes the stream's writer. After each arrival the stream runs to its end and stops; the
    next start recovers its state. All files of an arrival make one micro-batch.
    """
    source, checkpoint = scratch(t, "stream_in"), scratch(t, "stream_checkpoint")
    rows = checkpoint_frame(rows.withColumn("_part", part))
    schema = rows.drop("_part").schema
    for k in range(ARRIVALS):
        rows.where(F.col("_part") == k).drop("_part").write.mode("append").parquet(source)
        jobs.run_to_end(start(t.spark.readStream.schema(schema).parquet(source)), checkpoint)


def events_stream(t):
    """Events as a stream with a proper event time."""
    schema = t.raw("events").schema
    raw = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.path)
    item = F.get_json_object("props", "$.k").try_cast("int")
    return raw.select(
        "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), item.alias("item")
    )


def finish(t, stream, keys: list[str], mode: str = "update"):
    out, checkpoint = scratch(t, "stream_out"), scratch(t, "stream_checkpoint")
    writer = stream.writeStream.outputMode(mode).foreachBatch(jobs.batches_to(out))
    jobs.run_to_end(writer, checkpoint)
    return jobs.latest(t.spark, out, keys)


def draw_files(t):
    """The raw rows as draw files, one folder for each lottery."""
    source = scratch(t, "draw_files")
    rows = t.raw_draws.select("lottery_id", *csv.HEADER)
    (
        rows.write.partitionBy("lottery_id")
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(source)
    )
    return source


@job(
    "stream_import",
    f"""{CHECKED} SELECT DISTINCT v.lottery_id, v.draw_number, cast(r.draw_date AS date) AS draw_date
        FROM valid v JOIN raw_draws r ON r.lottery_id = v.lottery_id AND r.row_number = v.row_number""",
)
def _(t):
    source, target = draw_files(t), scratch(t, "stream_draws")
    jobs.stream_import(t.spark, source, target, scratch(t, "stream_checkpoint"), t.lottery)
    return importing.committed(t.spark, target).select("lottery_id", "draw_number", "draw_date")


@job(
    "import_files",
    f"""{CHECKED}, ok AS (SELECT lottery_id, count(*) AS n, count(DISTINCT draw_number) AS imported FROM valid GROUP BY 1)
        SELECT r.lottery_id, count(*) AS total_rows, any_value(imported) AS imported_rows,
               any_value(n - imported) AS duplicate_rows, count(*) - any_value(n) AS error_rows
        FROM raw_draws r JOIN ok ON ok.lottery_id = r.lottery_id GROUP BY 1""",
)
def _(t):
    """Counters of a batch import; a second run finds every file committed."""
    source, root = draw_files(t), scratch(t, "imported")
    importing.import_files(t.spark, source, root, t.lottery, files_per_batch=20)
    importing.import_files(t.spark, source, root, t.lottery, files_per_batch=20)
    counters = ["total_rows", "imported_rows", "duplicate_rows", "error_rows"]
    commits = importing.committed(t.spark, root, "commits")
    return commits.groupBy("lottery_id").agg(*[F.sum(c).alias(c) for c in counters])


@job(
    "stream_dedupe",
    """SELECT DISTINCT event_type, try_cast(json_extract_string(props, '$.k') AS int) AS item FROM events""",
)
def _(t):
    unique = jobs.stream_dedupe(events_stream(t), ["event_type", "item"], "ts", "60 days")
    out, checkpoint = scratch(t, "stream_out"), scratch(t, "stream_checkpoint")
    writer = unique.writeStream.outputMode("append").foreachBatch(jobs.batches_to(out))
    jobs.run_to_end(writer, checkpoint)
    return t.spark.read.parquet(out).select("event_type", "item")


@job("stream_frequency", "SELECT lottery_id, number, count(*) AS n FROM numbers GROUP BY 1, 2")
def _(t):
    out = scratch(t, "stream_out")
    part = (F.col("draw_number") % ARRIVALS).cast("int")
    in_arrivals(t, t.numbers, part, lambda stream: jobs.stream_frequency(stream).writeStream.outputMode("update").foreachBatch(
        jobs.batches_to(out)
    ))
    return jobs.latest(t.spark, out, jobs.NUMBER)


@job(
    "stream_gap_state",
    """g AS (
      SELECT lottery_id, number, draw_number,
             draw_number - lag(draw_number) OVER (PARTITION BY lottery_id, number ORDER BY draw_number) AS gap FROM numbers)
    SELECT lottery_id, number, max(draw_number) AS last_seen, count(gap) AS gap_count, min(gap) AS gap_min,
           max(gap) AS gap_max, cast(coalesce(sum(gap), 0) AS bigint) AS gap_sum FROM g GROUP BY 1, 2""",
)
def _(t):
    """Every arrival holds draws between those of the arrivals before it."""
    out = scratch(t, "stream_gaps")
    part = (F.col("draw_number") % ARRIVALS).cast("int")
    in_arrivals(t, t.numbers, part, lambda stream: stream.writeStream.foreachBatch(jobs.gap_batches(out)))
    return jobs.gap_state(t.spark, out)


@job(
    "fold_delta",
    "SELECT lottery_id, number, position, count(*) AS n FROM numbers GROUP BY 1, 2, 3",
)
def _(t):
    split = F.col("draw_date") < F.lit("1998-01-01").cast("date")
    old = jobs.accumulators(t.baskets.where(split))
    return jobs.fold_delta(old, jobs.accumulators(t.baskets.where(~split)))


ITEMS = "try_cast(json_extract_string(props, '$.k') AS int)"
DELAY = "1 hour"
CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def closed_windows(t, window):
    """Baskets of all windows that the watermark has closed: events arrive in time order, in append mode.

    Between the arrivals the stream stops, and windows that were open go on from its state.
    """
    out = scratch(t, "stream_out")
    events = t.events.select("event_type", F.col("ts").cast("timestamp").alias("ts"), "item")
    low, high = events.agg(F.min("ts").cast("double"), F.max("ts").cast("double")).first()
    place = (F.col("ts").cast("double") - low) / max(high - low, 1.0) * ARRIVALS
    part = F.least(F.floor(place), F.lit(ARRIVALS - 1)).cast("int")

    def start(stream):
        windows = jobs.windowed_draws(stream.withWatermark("ts", DELAY), "ts", "event_type", "item", window)
        return windows.writeStream.outputMode("append").foreachBatch(jobs.batches_to(out))

    in_arrivals(t, events, part, start)
    return as_text(t.spark.read.parquet(out))


def as_text(df):
    return df.select(
        "event_type",
        F.col("start").cast("timestamp_ntz").alias("start"),
        F.array_join(F.col("items").cast("array<string>"), ",").alias("items"),
    )


@job(
    "windowed_draws",
    f"""b AS (SELECT DISTINCT event_type, date_trunc('hour', ts) AS "start", {ITEMS} AS item FROM events)
        SELECT event_type, "start", string_agg(cast(item AS varchar), ',' ORDER BY item) AS items FROM b GROUP BY 1, 2""",
)
def _(t):
    marked = events_stream(t).withWatermark("ts", DELAY)
    stream = jobs.windowed_draws(marked, "ts", "event_type", "item", F.window("ts", "1 hour"))
    return as_text(finish(t, stream, ["event_type", "start", "end"]))


@job(
    "sliding_draws",
    f"""b AS (
      SELECT DISTINCT event_type, date_trunc('hour', ts) - INTERVAL (k) HOUR AS "start", {ITEMS} AS item
      FROM events, range(0, 3) r(k))
    SELECT event_type, "start", string_agg(cast(item AS varchar), ',' ORDER BY item) AS items FROM b
    WHERE "start" + INTERVAL 3 HOUR <= {CLOSED} GROUP BY 1, 2""",
)
def _(t):
    return closed_windows(t, F.window("ts", "3 hours", "1 hour"))


@job(
    "session_draws",
    f"""e AS (
      SELECT event_type, ts, {ITEMS} AS item,
             CASE WHEN ts < lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS opens
      FROM events),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY event_type ORDER BY ts) AS session FROM e),
    b AS (
      SELECT DISTINCT event_type, session, min(ts) OVER (PARTITION BY event_type, session) AS "start",
             max(ts) OVER (PARTITION BY event_type, session) + INTERVAL 10 MINUTE AS "end", item FROM s)
    SELECT event_type, "start", string_agg(cast(item AS varchar), ',' ORDER BY item) AS items FROM b
    WHERE "end" <= {CLOSED} GROUP BY 1, 2""",
)
def _(t):
    return closed_windows(t, F.session_window("ts", "10 minutes"))
