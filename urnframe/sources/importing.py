"""Import of draw files in committed batches, for batch jobs and for streams alike.

A batch is a set of files. Its draws, errors and refused files are written to folders named by the
batch, and a commit record with counters and the last line of each file comes last. Readers see
committed batches only; a batch that broke off is written again over its folders. Known keys are kept
apart in folders by ranges of draw numbers, so a batch reads those that it touches, not the table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urnframe.operators import ingest
from urnframe.session import checkpoint_frame
from urnframe.sources import csv
from urnframe.sources.sinks import quarantine_errors

KEY = ["lottery_id", "draw_number"]
RANGE_BITS = 16  # draw numbers of a key folder
KINDS = {
    "draws": "lottery_id int, draw_number bigint, draw_date date, numbers array<int>, super_number int,"
    " jackpot decimal(18,2), winners bigint, source_file string, line bigint, batch bigint",
    "errors": "lottery_id int, source_file string, line bigint, draw_number string, error_no int, error_code string,"
    " message string, raw_row string, batch bigint",
    "refused": "source_file string, code string, batch bigint",
    "commits": "lottery_id int, source_file string, last_line bigint, total_rows bigint, imported_rows bigint,"
    " duplicate_rows bigint, error_rows bigint, refused boolean, batch bigint",
}
TEXT = "lottery_id int, value string, source_file string, _block bigint"
KEYS = "lottery_id int, draw_number bigint, batch bigint, range bigint"


def file_lines(text: DataFrame) -> DataFrame:
    """Lines of text rows with a ``lottery_id`` and their file places: source_file, line, value.

    ``text`` has ``lottery_id``, ``value``, ``source_file`` and ``_block`` (:func:`csv.file_place`).
    Line numbers come from counts of blocks, so no file is one task.
    """
    place = ["source_file", "_block"]
    placed = text.withColumn("_at", F.monotonically_increasing_id())
    blocks = placed.groupBy(*place).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    order = W.partitionBy("source_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    line = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return placed.join(before, place).select("lottery_id", "source_file", line.alias("line"), "value")


def refused_files(lines: DataFrame) -> DataFrame:
    """source_file and code of every file that is refused as a whole: a broken header, a broken byte."""
    names = F.transform(F.split(F.regexp_replace("value", "^\\ufeff", ""), ","), lambda c: F.lower(F.trim(c, F.lit(" \t\r"))))
    wanted = F.array(*map(F.lit, csv.HEADER))
    code = (
        F.when(~F.is_valid_utf8("value"), "bad_encoding")
        .when(names == wanted, None)
        .when(F.size(F.array_except(wanted, names)) > 0, "missing_columns")
        .otherwise("unknown_columns")
    )
    heads = lines.where("line = 1").select("source_file", code.alias("code"))
    bad = lines.where((F.col("line") > 1) & ~F.is_valid_utf8("value")).select("source_file", F.lit("bad_encoding").alias("code"))
    return heads.unionByName(bad).where("code is not null").groupBy("source_file").agg(F.min("code").alias("code"))


def rows_of(lines: DataFrame) -> DataFrame:
    """All-text cells of the lines behind the header; blank lines are no rows."""
    schema = ", ".join(f"{c} string" for c in csv.HEADER)
    options = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "mode": "PERMISSIVE"}
    body = lines.where((F.col("line") > 1) & (F.trim("value", F.lit(" \t\r")) != ""))
    parsed = body.select("lottery_id", "source_file", "line", F.from_csv(F.rtrim("value", F.lit("\r")), schema, options).alias("c"))
    return parsed.select("lottery_id", "source_file", "line", *[F.coalesce(F.col(f"c.{c}"), F.lit("")).alias(c) for c in csv.HEADER])


def _folder(root: str, kind: str, batch: int) -> str:
    return f"{root.rstrip('/')}/{kind}/batch={batch}"


def _read(spark: SparkSession, root: str, kind: str, schema: str) -> DataFrame:
    """All batches of a kind; none before the first one is written."""
    base = f"{root.rstrip('/')}/{kind}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(base)


def committed(spark: SparkSession, root: str, kind: str = "draws") -> DataFrame:
    """Rows of ``kind`` (draws, errors, refused, commits) of the committed batches."""
    rows = _read(spark, root, kind, KINDS[kind])
    if kind == "commits":
        return rows
    done = _read(spark, root, "commits", KINDS["commits"]).select("batch").distinct()
    return rows.join(done, "batch", "left_semi").select(rows.columns)


def import_batch(lines: DataFrame, lottery: DataFrame, root: str, batch: int, empty: list[str] | None = None) -> None:
    """Validate the lines of a batch of files and write its draws, errors, refused files and commit.

    The first valid row of a key wins, by file and line; keys of earlier batches are known. Written
    again, a batch gives the same folders: what it wrote before is not among the known keys. ``empty``
    names the batch's files without a byte, which are refused, too.
    """
    spark = lines.sparkSession
    lines = checkpoint_frame(lines)
    without = spark.createDataFrame([(f, "empty_file") for f in empty or []], "source_file string, code string")
    refused = checkpoint_frame(refused_files(lines).unionByName(without))
    refused.write.mode("overwrite").parquet(_folder(root, "refused", batch))
    rows = rows_of(lines.join(refused, "source_file", "left_anti"))
    validated = checkpoint_frame(ingest.validate_rows(rows.withColumn("row_number", F.monotonically_increasing_id()), lottery))
    broken = quarantine_errors(validated).join(validated.select("row_number", "source_file", "line"), "row_number")
    broken.select("lottery_id", "source_file", "line", "draw_number", F.col("error_no").cast("int"), "error_code", "message", "raw_row").write.mode(
        "overwrite"
    ).parquet(_folder(root, "errors", batch))
    valid = validated.where(F.size("errors") == 0)
    places = valid.select("row_number", "source_file", "line")
    typed = ingest.normalize_rows(valid).join(places, "row_number").drop("row_number")
    others = [c for c in typed.columns if c not in KEY]
    first = typed.groupBy(*KEY).agg(F.min_by(F.struct(*others), F.struct("source_file", "line")).alias("_r")).select(*KEY, "_r.*")
    first = first.withColumn("range", F.shiftright("draw_number", RANGE_BITS))
    known = _read(spark, root, "keys", KEYS).where(F.col("batch") < batch)
    fresh = checkpoint_frame(first.join(known.select(*KEY, "range"), [*KEY, "range"], "left_anti"))
    fresh.drop("range").write.mode("overwrite").parquet(_folder(root, "draws", batch))
    fresh.select(*KEY, "range").write.mode("overwrite").partitionBy("range").parquet(_folder(root, "keys", batch))
    by_file = validated.groupBy("source_file").agg(
        F.count("*").alias("_rows"), F.count_if(F.size("errors") > 0).alias("error_rows")
    )
    imported = fresh.groupBy("source_file").agg(F.count("*").alias("imported_rows"))
    last = lines.groupBy("lottery_id", "source_file").agg(F.max("line").alias("last_line"))
    last = last.unionByName(without.select(F.lit(None).cast("int").alias("lottery_id"), "source_file", F.lit(0).cast("long").alias("last_line")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    record = last.join(by_file, "source_file", "left").join(imported, "source_file", "left").join(
        refused.select("source_file", F.lit(True).alias("refused")), "source_file", "left"
    )
    counted = record.select(
        "lottery_id", "source_file", "last_line", zero("_rows").alias("total_rows"), zero("imported_rows"),
        (F.coalesce("_rows", F.lit(0)) - F.coalesce("error_rows", F.lit(0)) - F.coalesce("imported_rows", F.lit(0)))
        .cast("long").alias("duplicate_rows"),
        zero("error_rows"), F.coalesce("refused", F.lit(False)).alias("refused"),
    )
    counted.write.mode("overwrite").parquet(_folder(root, "commits", batch))


def text_rows(reader, source, base: str | None = None) -> DataFrame:
    """Raw lines with lottery and file place, from a batch or a stream reader.

    Files lie in one folder for each ``lottery_id``.
    """
    if base:
        reader = reader.option("basePath", base)
    text = reader.schema("value string, lottery_id int").text(source)
    return text.select("lottery_id", "value", *csv.file_place())


def import_files(spark: SparkSession, source: str, root: str, lottery: DataFrame, files_per_batch: int = 100) -> int:
    """Import the files under ``source`` that no committed batch holds; the number of new batches.

    A run that broke off goes on behind its last commit. The files' names are those that Spark lists.
    """
    listed = [(re.sub("^file:/+", "file:/", f),) for f in spark.read.text(source).inputFiles()]
    if not listed:
        return 0
    full = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)  # leaves out empty files
    names = spark.createDataFrame(listed, "source_file string").join(
        full.select(F.col("_metadata.file_path").alias("source_file"), F.lit(True).alias("full")), "source_file", "left"
    )
    done = committed(spark, root, "commits")
    open_files = checkpoint_frame(names.join(done.select("source_file"), "source_file", "left_anti"))
    batch = (done.agg(F.max("batch")).first()[0] or 0) + 1
    count, after = 0, ""
    while True:
        own = open_files.where(F.col("source_file") > after).orderBy("source_file").limit(files_per_batch).collect()
        if not own:
            return count
        paths, empty = ([r["source_file"] for r in own if bool(r["full"]) is some] for some in (True, False))
        text = text_rows(spark.read, paths, source) if paths else spark.createDataFrame([], TEXT)
        import_batch(file_lines(text), lottery, root, batch, empty)
        after, batch, count = own[-1]["source_file"], batch + 1, count + 1


def stream_files(spark: SparkSession, source: str, root: str, checkpoint: str, lottery: DataFrame, files_per_batch: int = 100) -> None:
    """The same import as a stream, run to its end; the stream's checkpoint knows the files."""
    lines = text_rows(spark.readStream.option("maxFilesPerTrigger", files_per_batch), source)

    def load(batch: DataFrame, batch_id: int) -> None:
        import_batch(file_lines(batch), lottery, root, batch_id)

    query = lines.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
