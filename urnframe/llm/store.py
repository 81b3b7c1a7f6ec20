"""Lineage cuts as written tables, and sizes that Spark knows without running a job."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from urnframe.session import shared_dir

_open: list[list[DataFrame]] = []


def stored(df: DataFrame, *partition_by: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    A lost executor re-reads the table; nothing before it is computed twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/frames/{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if _open:
        _open[-1].append(table)
    return table


@contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Tables that ``stored`` writes inside are deleted at the end, but for those taken off the list.

    For results that no longer read them: values of the driver, or a written table.
    """
    made: list[DataFrame] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.pop()
        for table in made:
            dropped(table)


def dropped(table: DataFrame) -> None:
    """Delete a table that ``stored`` wrote and nothing will read again."""
    spark = table.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {file.rsplit("/frames/", 1)[0] + "/frames/" + file.rsplit("/frames/", 1)[1].split("/")[0]
                   for file in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def parts_for(df: DataFrame, bytes_each: int, least: int = 1) -> int:
    """A number of parts of about ``bytes_each`` bytes of files, from Spark's own statistics.

    Where Spark knows no size (rows that come from no file), the session's shuffle partitions.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return min(max(least, -(-size // bytes_each)), 1 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns renamed to ``c0``, ``c1`` and so on, and the new name of each old one.

    Work on the renamed table may add columns of any other name: no user's column has them.
    """
    new = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*new), dict(zip(df.columns, new))


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores in front until no column of ``taken`` has it (case aside)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name
