"""Row digests, table fingerprints and the life cycle of versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urnframe.functions.columns import row_digest

WORD_HEX, WORDS = 6, 10


def digest_words(digest: Column | str) -> list[Column]:
    """The first 60 hex digits of a sha-256 as ten 24-bit integers."""
    text = F.col(digest) if isinstance(digest, str) else digest
    return [
        F.conv(F.substring(text, 1 + WORD_HEX * i, WORD_HEX), 16, 10).cast("long")
        for i in range(WORDS)
    ]


def digest_sums(digests: DataFrame, by: Sequence[str], column: str = "digest") -> DataFrame:
    """Mergeable accumulator of a multiset of row digests: a count and ten word sums.

    24-bit words leave room for 2**39 rows in a bigint. Sums of two parts add up to the sums of
    the whole, so a fingerprint can be folded forward with a delta.
    """
    words = digest_words(column)
    keyed = digests.select(*by, *[w.alias(f"w{i}") for i, w in enumerate(words)])
    sums = [F.coalesce(F.sum(f"w{i}"), F.lit(0)).alias(f"w{i}") for i in range(WORDS)]
    return keyed.groupBy(*by).agg(F.count("*").alias("row_count"), *sums)


def close_digest(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    text = F.concat_ws("|", F.col("row_count"), *[F.col(f"w{i}") for i in range(WORDS)])
    return sums.select(*by, "row_count", F.sha2(text, 256).alias("fingerprint"))


def additive_digest(digests: DataFrame, by: Sequence[str]) -> DataFrame:
    return close_digest(digest_sums(digests, by), by)


def table_fingerprint(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One digest per ``by`` group, whatever the row order or partitioning.

    Only counts and sums are shuffled, one small row per task and group; copies of one row and
    hot groups are combined map-side. Row order enters through the key columns.
    """
    digests = df.select(*by, row_digest(*[F.col(c) for c in columns]).alias("digest"))
    return additive_digest(digests, list(by))


def input_fingerprint(parameters: dict[str, object], data: Column, generator: str) -> Column:
    """Identity of a result: sorted parameters, data fingerprint, generator version."""
    pairs = [F.lit(x) for k in sorted(parameters) for x in (k, parameters[k])]
    return row_digest(*pairs, data, F.lit(generator))


def active_snapshot(snapshots: DataFrame) -> DataFrame:
    """Newest active version of every scope."""
    active = snapshots.where(F.col("status") == "active")
    newest = F.max_by(F.struct("version", "fingerprint"), "version")
    return active.groupBy("scope").agg(newest.alias("s")).select("scope", "s.*")


def find_by_fingerprint(snapshots: DataFrame, wanted: DataFrame) -> DataFrame:
    """Active snapshots whose (scope, fingerprint) is among the wanted ones."""
    active = snapshots.where(F.col("status") == "active")
    return active.join(wanted, ["scope", "fingerprint"], "left_semi")


def next_version(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("scope").agg((F.max("version") + 1).alias("next_version"))


def retire_versions(snapshots: DataFrame) -> DataFrame:
    """Status view of the append-only log: active rows below the newest active are retired."""
    newest = (
        snapshots.where(F.col("status") == "active")
        .groupBy("scope")
        .agg(F.max("version").alias("_newest"))
    )
    older = (F.col("status") == "active") & (F.col("version") < F.col("_newest"))
    return snapshots.join(newest, "scope", "left").select(
        "scope",
        "version",
        F.when(older, "retired").otherwise(F.col("status")).alias("status"),
    )


def expired_versions(snapshots: DataFrame, keep: int = 10) -> DataFrame:
    """Retired versions older than the newest ``keep`` retired ones of their scope.

    Only ``keep`` rows per scope and task are sorted (window group limit); the rest is compared
    with the oldest version kept.
    """
    retired = snapshots.where(F.col("status") == "retired")
    rank = F.row_number().over(W.partitionBy("scope").orderBy(F.desc("version")))
    edge = (
        retired.select("scope", "version")
        .withColumn("_r", rank)
        .where(F.col("_r") <= keep)
        .groupBy("scope")
        .agg(F.min("version").alias("_edge"))
    )
    return (
        retired.join(edge, "scope")
        .where(F.col("version") < F.col("_edge"))
        .select("scope", "version")
    )


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows on one side only, copies counted; empty when both generations are identical."""
    cols = old.columns
    tagged = old.select(*cols, F.lit(-1).alias("_s")).unionByName(
        new.select(*cols, F.lit(1).alias("_s"))
    )
    surplus = tagged.groupBy(*cols).agg(F.sum("_s").alias("_d")).where(F.col("_d") != 0)
    side = F.when(F.col("_d") > 0, "added").otherwise("removed")
    return surplus.select(*cols, side.alias("change"), F.abs("_d").alias("copies"))
