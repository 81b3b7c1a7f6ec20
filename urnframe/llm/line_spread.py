"""Line deduplication by the number of distinct sites that a line appears on.

HyperLogLog sketches per line hash merge by aggregation. Lines whose estimate is near the
threshold get exact distinct counts. Lines above the threshold are cross-site boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urnframe.llm.store import numbered, stored, table

SITES = 10
BLANK = " \t\r"
LG_K = 10  # 1,024 registers; relative standard error about 3.3 %
MARGIN = 0.2  # estimates this near to the threshold are counted exactly: six standard errors


def line_text(line: Column) -> Column:
    """A line without surrounding blanks; lines are compared in this form."""
    return F.btrim(line, F.lit(BLANK))


def _numbered(docs: DataFrame) -> DataFrame:
    """One row per line that is not blank: hash of the line, site."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"),
        F.explode(F.split(text, "\n")).alias("line"),
    ).select("site", line_text(F.col("line")).alias("line")).where(F.col("line") != "").select(
        "site", F.xxhash64("line").alias("line_hash")
    )


def line_spread(docs: DataFrame, sites: int = SITES, margin: float = MARGIN) -> DataFrame:
    """Lines on at least ``sites`` distinct sites: line_hash, n_sites, exact.

    A null source is a site of its own. ``n_sites`` is the exact count where ``exact``, otherwise
    the estimate of the sketch, which lies beyond the margin. Blank lines are never counted.
    """
    lines = _numbered(docs)
    # a line of fewer rows than sites is on fewer sites; of the others, a sketch per line and task, then their union
    often = stored(lines.groupBy("line_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= sites).select("line_hash"))
    sketches = lines.join(often, "line_hash", "left_semi").groupBy("line_hash").agg(
        F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch")
    )
    sized = sketches.select("line_hash", F.hll_sketch_estimate("sketch").alias("estimate"))
    high = stored(sized.where(F.col("estimate") >= sites * (1 - margin)))
    sure = high.where(F.col("estimate") > sites * (1 + margin))
    near = high.where(F.col("estimate") <= sites * (1 + margin))
    counted = (
        lines.join(near.select("line_hash"), "line_hash", "left_semi")
        .groupBy("line_hash")
        .agg(F.countDistinct("site").alias("n_sites"))
        .where(F.col("n_sites") >= sites)
    )
    return counted.select("line_hash", "n_sites", F.lit(True).alias("exact")).unionByName(
        sure.select("line_hash", F.col("estimate").alias("n_sites"), F.lit(False).alias("exact"))
    )


def without_boilerplate(docs: DataFrame, sites: int = SITES, margin: float = MARGIN) -> DataFrame:
    """All columns of ``docs``; boilerplate lines are gone from ``text``, ``n_chars`` follows.

    Other lines and their order stay as they are. A document that would lose every line with
    text is a copy of a whole document, not boilerplate, and stays as it is: whole copies are for
    the near-duplicate operators. A null text stays null.
    """
    return _cleaned(docs, sites, margin, [])


def _cleaned(docs: DataFrame, sites: int, margin: float, extra: list[str]) -> DataFrame:
    """All columns of ``docs`` with clean texts, then the named columns of ``n_lines`` and ``n_removed``."""
    spread = stored(line_spread(docs, sites, margin).select("line_hash"))
    rows, new = numbered(docs)
    body = F.split(F.coalesce(F.col("_text"), F.lit("")), "\n")
    keyed = rows.withColumn("_text", F.col(new["text"]).cast("string"))
    # what a text loses follows from the text: its 96-bit hash is the key, and copies share a row
    keyed = keyed.withColumn("_k", F.xxhash64("_text")).withColumn("_m", F.hash("_text"))
    hits = (
        keyed.select("_k", "_m", F.posexplode(body).alias("at", "line"))
        .select("_k", "_m", "at", line_text(F.col("line")).alias("line"))
        .where(F.col("line") != "")
        .select("_k", "_m", "at", F.xxhash64("line").alias("line_hash"))
        .join(spread, "line_hash", "left_semi")
        .groupBy("_k", "_m")
        .agg(F.collect_set("at").alias("_gone"))
    )
    joined = keyed.join(hits, ["_k", "_m"], "left")
    kept = F.filter(body, lambda line, i: ~F.array_contains(F.col("_gone"), i))
    full = lambda a: F.size(F.filter(a, lambda line: line_text(line) != ""))
    joined = joined.withColumn("_kept", F.when(F.col("_gone").isNotNull(), kept))
    change = F.col("_gone").isNotNull() & (full(F.col("_kept")) > 0)
    out = joined.withColumn("_new", F.when(change, F.array_join("_kept", "\n")).otherwise(F.col("_text")))
    values = {
        "text": F.col("_new"),
        "n_chars": F.when(change, F.length("_new").cast("bigint")).otherwise(F.col(new.get("n_chars", "_k"))),
    }
    counts = {
        "n_lines": full(body).cast("bigint"),
        "n_removed": F.when(change, F.size("_gone")).otherwise(F.lit(0)).cast("bigint"),
    }
    columns = [values.get(c, F.col(k)).alias(c) for c, k in new.items()]
    return out.select(*columns, *(counts[c].alias(c) for c in extra))


def op5_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    cleaned = _cleaned(docs, SITES, MARGIN, ["n_lines", "n_removed"])
    return cleaned.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


OP5_SQL = f"""
WITH d AS (SELECT doc_id, text, coalesce(source, '') AS site, row_number() OVER () AS r FROM documents),
raw AS (
  SELECT r, site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM d
),
l AS (SELECT r, site, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS k FROM raw),
wide AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT site) >= {SITES}),
m AS (SELECT l.r, l.pos, l.line, l.k, w.k IS NOT NULL AS gone FROM l LEFT JOIN wide w ON l.k = w.k),
s AS (
  SELECT r, count(*) FILTER (k <> '') AS n_lines, count(*) FILTER (gone) AS n_gone,
    string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS body
  FROM m GROUP BY r
)
SELECT d.doc_id, s.n_lines,
  CASE WHEN s.n_gone < s.n_lines THEN s.n_gone ELSE 0 END AS n_removed,
  md5(CASE WHEN s.n_gone > 0 AND s.n_gone < s.n_lines THEN s.body ELSE d.text END) AS kept_md5
FROM d JOIN s ON d.r = s.r
"""
