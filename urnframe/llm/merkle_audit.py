"""Merkle fixity audit of replicas of an archive, in DataFrame operations.

Records are hashed one by one; records of an archive file are gathered by ordered ranges of
offsets, and ranges by ranges of ranges, up to one root. Two replicas are compared from the root
down: only the children of nodes that differ are read, until single records are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urnframe.llm.store import stored, table

RANGE = 1 << 18  # bytes of offsets of a lowest range
FANOUT = 64  # children of a node
INSIDE = 2  # levels of ranges above the lowest, below a file's root
FILES = 3  # levels of ranges of files, below the root
KEYS = 4096  # keys of a file that ``manifest`` lays out
NO_KEY = -(2**62)  # stands for the file of a null key
BEYOND = RANGE * FANOUT**INSIDE - 1  # where records are put that the manifest doesn't know


def record_digests(records: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """record, digest, n_bytes: one row for each key.

    A record's hash covers every payload column, its length and whether it is null. Records that
    share a key are one leaf: the digest is of their number and of the sums of their hashes'
    parts, which merge in any order, so no key's records are ever gathered. A null key is one key.
    """
    parts: list[Column] = []
    for c in payload:
        text = F.col(c).cast("string")
        parts += [F.coalesce(F.octet_length(text).cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))]
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in payload), F.lit(0))
    each = records.select(
        F.col(key).cast("bigint").alias("record"), F.sha2(F.concat_ws("|", *parts), 256).alias("body"), size.cast("bigint").alias("n_bytes")
    )
    sums = [F.sum(F.conv(F.substring("body", 1 + 16 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(4)]
    merged = each.groupBy("record").agg(F.count(F.lit(1)).alias("copies"), F.sum("n_bytes").alias("n_bytes"), *sums)
    words = [F.col(c).cast("string") for c in ("copies", "s0", "s1", "s2", "s3")]
    return merged.select("record", F.sha2(F.concat_ws("|", *words), 256).alias("digest"), "n_bytes")


def manifest(digests: DataFrame, keys: int = KEYS) -> DataFrame:
    """record, file, offset, digest: records in order of their key, ``keys`` keys a file.

    A file holds a bounded range of keys, so its offsets are one small running sum.
    """
    file = F.coalesce(F.floor(F.col("record") / keys).cast("bigint"), F.lit(NO_KEY))
    before = Window.partitionBy("file").orderBy("record").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n_bytes").over(before), F.lit(0)).cast("bigint")
    return digests.withColumn("file", file).withColumn("offset", offset).select("record", "file", "offset", "digest")


def placed(digests: DataFrame, known: DataFrame, keys: int = KEYS) -> DataFrame:
    """A replica's records at the manifest's offsets; unknown ones at the end of their file."""
    places = known.select(F.col("record").alias("_record"), F.col("file").alias("_file"), F.col("offset").alias("_offset"))
    file = F.coalesce("_file", F.floor(F.col("record") / keys).cast("bigint"), F.lit(NO_KEY))
    return digests.join(places, F.col("record").eqNullSafe(F.col("_record")), "left").select(
        "record", file.alias("file"), F.coalesce("_offset", F.lit(BEYOND).cast("bigint")).alias("offset"), "digest"
    )


def _combined(children: DataFrame, *order: str) -> DataFrame:
    """Nodes (file, node) over their children: a digest of their places and digests, in order."""
    listed = F.sort_array(F.collect_list(F.struct(*order, "digest")))
    text = lambda x: F.concat_ws(":", *(F.coalesce(x[c].cast("string"), F.lit("")) for c in (*order, "digest")))
    return children.groupBy("file", "node").agg(F.sha2(F.array_join(F.transform(listed, text), ","), 256).alias("digest"))


def merkle_tree(leaves: DataFrame) -> DataFrame:
    """Nodes (level, file, node, digest) over ``record, file, offset, digest``.

    Level 0 has the ranges of ``RANGE`` bytes of a file's offsets, each further level ranges
    ``FANOUT`` times as wide; a range without records has no node. Above stand the files' roots,
    ranges of file numbers and the root, on file -1. A node has at most ``FANOUT`` children where
    files keep to ``RANGE * FANOUT**INSIDE`` bytes and ``FANOUT**(FILES+1)`` in number.
    """
    wider = F.floor(F.col("node") / FANOUT).cast("bigint")
    level = _combined(leaves.withColumn("node", F.floor(F.col("offset") / RANGE).cast("bigint")), "offset", "record")
    levels = [level]
    for _ in range(INSIDE):
        level = _combined(level.select("file", F.col("node").alias("child"), wider.alias("node"), "digest"), "child")
        levels.append(level)
    top = F.lit(-1).cast("bigint").alias("file")
    level = _combined(level.select(top, F.col("node").alias("child"), F.col("file").alias("node"), "digest"), "child")
    levels.append(level)
    for _ in range(FILES):
        level = _combined(level.select("file", F.col("node").alias("child"), wider.alias("node"), "digest"), "child")
        levels.append(level)
    level = _combined(level.select("file", F.col("node").alias("child"), F.lit(0).cast("bigint").alias("node"), "digest"), "child")
    levels.append(level)
    nodes = None
    for n, level in enumerate(levels):
        own = level.select(F.lit(n).alias("level"), "file", "node", "digest")
        nodes = own if nodes is None else nodes.unionByName(own)
    return nodes


def _parent(level: int) -> tuple[Column, Column]:
    """File and node of a node's parent."""
    wider = F.floor(F.col("node") / FANOUT).cast("bigint")
    top = F.lit(-1).cast("bigint")
    if level < INSIDE:
        return F.col("file"), wider
    if level == INSIDE:
        return top, F.col("file")
    return top, wider if level < INSIDE + 1 + FILES else F.lit(0).cast("bigint")


def _differing(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Keys whose digests differ or that one side lacks, with both digests."""
    left = a.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("digest").alias("first"))
    right = b.select(*by, F.col("digest").alias("second"))
    same = None
    for c in by:
        one = F.col(f"_{c}").eqNullSafe(F.col(c))
        same = one if same is None else same & one
    joined = left.join(right, same, "full").where(~F.col("first").eqNullSafe(F.col("second")))
    side = F.col("first").isNotNull()
    return joined.select(*(F.when(side, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in by), "first", "second")


def audit(first: DataFrame, second: DataFrame, first_leaves: DataFrame, second_leaves: DataFrame) -> DataFrame:
    """record, file, offset, kind: where two replicas differ, found from the roots down.

    ``kind`` is ``missing`` or ``extra`` where the second replica lacks a record or has one more,
    else ``altered``. Equal roots end the search with no rows; every level reads the children of
    differing nodes alone. An offset is null where the first replica lacks the record.
    """
    want = None
    for level in range(INSIDE + 2 + FILES, -1, -1):
        sides = []
        for tree in (first, second):
            own = tree.where(F.col("level") == level).select("file", "node", "digest")
            if want is not None:
                file, node = _parent(level)
                own = own.withColumn("_pf", file).withColumn("_pn", node).join(want, ["_pf", "_pn"], "left_semi")
            sides.append(own)
        differing = _differing(*sides, ["file", "node"])
        want = stored(differing.select(F.col("file").alias("_pf"), F.col("node").alias("_pn")))
    sides = [
        leaves.withColumn("_pf", F.col("file")).withColumn("_pn", F.floor(F.col("offset") / RANGE).cast("bigint")).join(want, ["_pf", "_pn"], "left_semi")
        for leaves in (first_leaves, second_leaves)
    ]
    kind = F.when(F.col("second").isNull(), "missing").when(F.col("first").isNull(), "extra").otherwise("altered")
    return _differing(*sides, ["file", "offset", "record"]).select(
        "record", "file", F.when(F.col("first").isNotNull(), F.col("offset")).alias("offset"), kind.alias("kind")
    )


def compare_replicas(first: DataFrame, second: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Hash both replicas, build their trees and report where they differ (see ``audit``).

    Empty tables have no nodes; against an empty replica every record is missing. Repeated
    records count: one copy less is an alteration. Columns outside ``payload`` are not covered.
    """
    known = stored(manifest(record_digests(first, key, payload)))
    other = stored(placed(record_digests(second, key, payload), known))
    return audit(stored(merkle_tree(known), "level"), stored(merkle_tree(other), "level"), known, other)


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known damage, by a hash of the url: altered, lost and added pages."""
    mark = F.substring(F.md5("url"), 1, 2)
    kept = pages.where(F.coalesce(mark != "01", F.lit(True)))
    bad = kept.withColumn("html", F.when(mark == "00", F.concat(F.col("html"), F.lit("!"))).otherwise(F.col("html")))
    added = pages.where(mark == "02").withColumn("page_id", -F.col("page_id") - 1)
    return bad.unionByName(added)


def op2_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return compare_replicas(pages, damaged(pages), "page_id", ["url", "html"])


OP2_SQL = f"""
WITH p AS (
  SELECT page_id, url, html, substr(md5(url), 1, 2) AS mark, page_id // {KEYS} AS file,
    coalesce(sum(coalesce(strlen(url), 0) + coalesce(strlen(html), 0)) OVER (
      PARTITION BY page_id // {KEYS} ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM pages
)
SELECT page_id AS record, file, CAST(off AS BIGINT) AS "offset", CASE mark WHEN '00' THEN 'altered' ELSE 'missing' END AS kind
FROM p WHERE mark = '01' OR (mark = '00' AND html IS NOT NULL)
UNION ALL
SELECT -page_id - 1, CAST(floor((-page_id - 1) / {KEYS}.0) AS BIGINT), NULL, 'extra' FROM p WHERE mark = '02'
"""
