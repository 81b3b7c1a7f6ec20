"""Draw history files: header contract, distributed row numbers, checksums."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed header of a draw file, in this order.
HEADER = ["draw_number", "draw_date", "numbers", "super_number", "jackpot", "winners"]

SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in HEADER])


RANGES = pa.schema([("source_file", pa.string()), ("_range", pa.int64()), ("_digest", pa.binary())])


class HeaderError(ValueError):
    """The file as a whole is refused; ``codes`` says why."""

    def __init__(self, codes: Sequence[str]):
        super().__init__(", ".join(codes))
        self.codes = list(codes)


def file_place() -> list[Column]:
    """Where a row lies in its file."""
    return [
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    ]


def header_problems(columns: Sequence[str]) -> list[str]:
    """Codes for an empty, incomplete, foreign or reordered header."""
    names = [c.strip().lower() for c in columns]
    if not names:
        return ["empty_file"]
    if names == HEADER:
        return []
    codes = []
    if set(HEADER) - set(names):
        codes.append("missing_columns")
    if set(names) - set(HEADER) or not codes:
        codes.append("unknown_columns")
    return codes


def check_header(spark: SparkSession, path: str) -> None:
    """Raise before any row is read when the first line of any file breaks the contract.

    Every different first line is looked at, one by one; an empty file breaks it too.
    """
    lines = spark.read.text(path)
    first = (
        lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
        .where("at = 0")
        .select("file", F.struct(F.monotonically_increasing_id().alias("id"), "value").alias("line"))
        .groupBy("file")
        .agg(F.min("line")["value"].alias("header"))
        .groupBy("header")
        .agg(F.count("*").alias("files"))
    )
    seen = 0
    for row in first.toLocalIterator():
        seen += row["files"]
        problems = header_problems(row["header"].lstrip("﻿").split(","))
        if problems:
            raise HeaderError(problems)
    if seen < max(1, len(lines.inputFiles())):  # a file without a line
        raise HeaderError(["empty_file"])


def read_draw_csv(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """All-text rows of every file under ``path`` with their physical ``row_number``.

    The header is line 1. Lines are numbered from per-block counts, so a file is never read by
    a single task: block sizes are summed in file order and added to the place in the block. With
    ``check``, a broken header of any file is an error, and a file with a byte that is not UTF-8
    gives no rows (:func:`undecodable_files` names it).
    """
    if check:
        check_header(spark, path)
    rows = (
        spark.read.schema(SCHEMA)
        .option("header", True)
        .option("enforceSchema", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    numbered = number_lines(rows.select("*", *file_place()))
    return numbered.join(undecodable_files(spark, path), "source_file", "left_anti") if check else numbered


def number_lines(rows: DataFrame) -> DataFrame:
    """Replace the file place of every row by its line number; see :func:`read_draw_csv`."""
    place = ["source_file", "_block"]
    extra = [c for c in rows.columns if c not in HEADER and c not in place]
    cells = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in HEADER]
    placed = rows.select(*place, *extra, *cells, F.monotonically_increasing_id().alias("_at"))
    blocks = placed.groupBy(*place).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    order = W.partitionBy("source_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    line = F.col("_before") + F.col("_at") - F.col("_first") + 2
    return placed.join(offsets, place).select(
        "source_file", *extra, line.alias("row_number"), *HEADER
    )


def undecodable_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` with a line that is not valid UTF-8; such a file is refused as a whole.

    The text reader keeps the bytes of a line as they are.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_file"), "value")
    return lines.where(~F.is_valid_utf8("value")).select("source_file").distinct()


def _line_pieces(spark: SparkSession, path: str, files: DataFrame, size: int) -> DataFrame:
    """The bytes of ``files`` (source_file, length) cut at line ends and at multiples of ``size``.

    Lines end at the byte 10 and keep everything else. Their places are running sums of lengths in
    their block and over the blocks, so the pieces do not depend on where Spark splits a file. The
    reader drops a byte order mark and the last line may lack its end; both show in the sum.
    """
    place = ["source_file", "_block"]
    lines = spark.read.option("lineSep", "\n").text(path).select(
        *file_place(), F.monotonically_increasing_id().alias("_at"), F.col("value").cast("binary").alias("_raw")
    )
    lines = lines.join(files.select("source_file"), "source_file", "left_semi")
    sized = lines.withColumn("_long", F.octet_length("_raw").cast("long") + 1)
    blocks = sized.groupBy(*place).agg(F.sum("_long").alias("_n"))
    before = W.partitionBy("source_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("source_file")
    blocks = blocks.select(
        *place, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_all")
    ).join(files, "source_file")
    spare = F.col("length") - F.col("_all")  # mark of 3 bytes or none, last end there or not
    wrong = F.raise_error(F.concat(F.lit("cannot place the lines of "), F.col("source_file"))).cast("long")
    mark = F.when(spare.isin(0, -1), 0).when(spare.isin(3, 2), 3).otherwise(wrong)
    blocks = blocks.select(*place, "_before", "length", mark.alias("_mark"))
    upto = F.coalesce(F.sum("_long").over(W.partitionBy(*place).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumn("_upto", upto).join(blocks, place)
    first = (F.col("_before") == 0) & (F.col("_upto") == 0)
    start = F.when(first, 0).otherwise(F.col("_before") + F.col("_upto") + F.col("_mark"))
    raw = F.concat(
        F.when(first & (F.col("_mark") == 3), F.lit(b"\xef\xbb\xbf")).otherwise(F.lit(b"")), F.col("_raw"), F.lit(b"\n")
    )
    full = placed.select("source_file", "length", start.alias("_start"), raw.alias("_raw"))
    end = F.least(F.col("_start") + F.octet_length("_raw"), F.col("length"))
    ranges = F.sequence(F.floor(F.col("_start") / size), F.floor((end - 1) / size))
    cut = full.select("source_file", "_start", end.alias("_end"), "_raw", F.explode(ranges).alias("_range"))
    low = F.greatest(F.col("_start"), F.col("_range") * size)
    high = F.least(F.col("_end"), (F.col("_range") + 1) * size)
    part = F.substring(F.col("_raw"), (low - F.col("_start") + 1).cast("int"), (high - low).cast("int"))
    return cut.where(F.col("_start") < F.col("_end")).select("source_file", "_range", low.alias("_low"), part.alias("_part"))


def _hash_in_order(batches):
    """SHA-256 of the pieces of every (file, range), which come together and in order."""
    names = ["source_file", "_range", "_digest"]
    key, digest = None, None
    for batch in batches:
        done = []
        for file, number, part in zip(*(batch[c].to_pylist() for c in ("source_file", "_range", "_part"))):
            if (file, number) != key:
                if key is not None:
                    done.append((*key, digest.digest()))
                key, digest = (file, number), hashlib.sha256()
            digest.update(part)
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done], RANGES)
    if key is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, digest.digest())))], RANGES)


def range_checksum(spark: SparkSession, path: str, files: DataFrame, size: int) -> DataFrame:
    """The checksum of ``files`` (source_file, length) from their ranges of ``size`` bytes.

    A range is hashed piece by piece in one task; nothing larger than a line is held.
    """
    pieces = _line_pieces(spark, path, files, size)
    dealt = pieces.repartition("source_file", "_range").sortWithinPartitions("source_file", "_range", "_low")
    hashed = dealt.mapInArrow(_hash_in_order, "source_file string, _range bigint, _digest binary")
    leaves = F.sort_array(F.collect_list(F.struct("_range", "_digest")))["_digest"]
    folded = F.aggregate(leaves, F.lit(b""), lambda a, d: F.concat(a, d))
    root = F.when(F.size(leaves) == 1, F.lower(F.hex(leaves[0]))).otherwise(F.sha2(folded, 256))
    return hashed.groupBy("source_file").agg(root.alias("checksum"))


def file_checksum(spark: SparkSession, path: str, whole_up_to: int = 1 << 30) -> DataFrame:
    """Tree digest per file, over fixed ranges of ``whole_up_to`` bytes.

    Each range has its sha-256. A file of one range has that one, so it is the sha-256 of its
    bytes; a longer file has the sha-256 of the digests of its ranges in order. The digest depends
    on the bytes alone, not on how Spark splits the file. Files must not be compressed.
    """
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= whole_up_to).select(
        F.col("path").alias("source_file"), F.sha2("content", 256).alias("checksum")
    )
    sizes = files.select(F.col("path").alias("source_file"), "length")
    large = range_checksum(spark, path, sizes.where(F.col("length") > whole_up_to), whole_up_to)
    return small.unionByName(large)
