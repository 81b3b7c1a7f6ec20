"""Bounded training samples, and the feature rows of their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    name = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(name.cast("string"), F.lit("")).cast("binary")) % n


def sample_ids(rows: DataFrame, target: str, each: int, classes: int) -> DataFrame:
    """At most ``each`` ids of every value of ``target``, the first by a hash of the id.

    ``classes`` bounds the number of values; the most common ones are sampled (ties: the least).
    The ids are distinct.
    """
    from pyspark.sql import Window

    known = rows.select("doc_id", target).where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).withColumn(
        "_order", F.xxhash64(F.col("doc_id"), F.lit(7))
    )
    counts = known.groupBy(target).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), target).limit(classes)
    # the first ``each`` of n even hashes lie below this share of their range: eight standard deviations to spare
    share = F.least(F.lit(1.0), (each + 8 * F.sqrt(F.lit(float(each))) + 16) / F.col("_n"))
    bound = counts.select(target, (share * float(2**64) - float(2**63)).alias("_bound"))
    first = known.join(F.broadcast(bound), target).where(F.col("_order").cast("double") <= F.col("_bound"))
    w = Window.partitionBy(target).orderBy("_order", "doc_id")
    first = first.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= each)
    return first.groupBy("doc_id").agg(F.min(target).alias(target)).orderBy(F.xxhash64("doc_id")).limit(each * classes)
