"""Catalog: scans, reads and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from urnframe.operators import graph, lookup, scan, stats
from urnframe.plans.registry import job

FREQ = "freq AS (SELECT lottery_id, number, count(*) AS n FROM numbers GROUP BY 1, 2)"
GAPS = """
gap_rows AS (
  SELECT n.lottery_id, n.number, n.draw_number,
         b.idx - lag(b.idx) OVER (PARTITION BY n.lottery_id, n.number ORDER BY b.idx) AS gap
  FROM numbers n JOIN baskets b ON b.lottery_id = n.lottery_id AND b.draw_number = n.draw_number),
gaps AS (
  SELECT lottery_id, number, count(gap) AS gap_count, min(gap) AS gap_min, max(gap) AS gap_max,
         round(avg(gap), 6) AS gap_avg
  FROM gap_rows GROUP BY 1, 2)"""
ENTROPY = """
entropies AS (
  SELECT lottery_id, round(sum(-p * log2(p)), 6) AS entropy
  FROM (SELECT lottery_id, n / sum(n) OVER (PARTITION BY lottery_id) AS p FROM freq) GROUP BY 1)"""
AVERAGES = """
averages AS (
  SELECT lottery_id, 'jackpot' AS series, round(avg(jackpot), 4) AS mean, count(jackpot) AS non_null
  FROM baskets GROUP BY 1
  UNION ALL
  SELECT lottery_id, 'winners', round(avg(winners), 4), count(winners) FROM baskets GROUP BY 1)"""
PAIRS = """
pairs AS (
  SELECT x.lottery_id, x.number AS a, y.number AS b, count(*) AS weight
  FROM numbers x JOIN numbers y ON x.draw_number = y.draw_number AND x.number < y.number
  GROUP BY 1, 2, 3)"""


def recent(n: int) -> str:
    return f"""
recent{n} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY lottery_id ORDER BY draw_number DESC) AS newest FROM baskets)
  WHERE newest <= {n}),
counts{n} AS (
  SELECT r.lottery_id, m.number, count(*) AS n
  FROM recent{n} r JOIN members m ON m.draw_number = r.draw_number GROUP BY 1, 2)"""


@job(
    "scan_draws",
    """SELECT b.lottery_id, b.draw_number, b.draw_date,
              string_agg(cast(n.number AS varchar), ',' ORDER BY n.position) AS numbers
       FROM baskets b JOIN numbers n ON n.draw_number = b.draw_number GROUP BY 1, 2, 3""",
)
def _(t):
    out = scan.scan_draws(t.draws, t.draw_numbers)
    return out.select("lottery_id", "draw_number", "draw_date", F.array_join("numbers", ",").alias("numbers"))


@job(
    "scan_delta",
    """SELECT b.lottery_id, b.draw_number,
              string_agg(cast(n.number AS varchar), ',' ORDER BY n.position) AS numbers
       FROM baskets b JOIN numbers n ON n.draw_number = b.draw_number
       WHERE b.draw_number > 700 GROUP BY 1, 2""",
)
def _(t):
    out = scan.scan_delta(t.draws, t.draw_numbers, after=700)
    return out.select("lottery_id", "draw_number", F.array_join("numbers", ",").alias("numbers"))


@job(
    "read_backtest_draws",
    """SELECT b.lottery_id, b.draw_number, b.draw_date, b.super_number,
              string_agg(cast(n.number AS varchar), ',' ORDER BY n.number) AS numbers
       FROM (SELECT lottery_id, draw_number, draw_date,
                    CASE WHEN super_number <= 12 THEN super_number END AS super_number FROM baskets) b
       JOIN numbers n ON n.draw_number = b.draw_number GROUP BY 1, 2, 3, 4""",
)
def _(t):
    supers = t.draws.where("super_number <= 12").select("lottery_id", "draw_number", "super_number")
    out = scan.read_backtest_draws(t.draws, t.draw_numbers, supers)
    return out.withColumn("numbers", F.array_join("numbers", ","))


@job("explode_numbers", "SELECT lottery_id, draw_number, position, number FROM numbers")
def _(t):
    return scan.explode_numbers(t.visible)


@job(
    "list_draws",
    """SELECT d.lottery_id, draw_number, draw_date, code FROM draws d JOIN lottery l USING (lottery_id)
       WHERE code = '2-HIGH' AND NOT is_deleted
         AND draw_date BETWEEN date '1996-01-01' AND date '1998-12-31'""",
)
def _(t):
    out = lookup.list_draws(t.draws, t.lottery, "2-HIGH", "1996-01-01", "1998-12-31")
    return out.select("lottery_id", "draw_number", "draw_date", "code")


@job(
    "page_draws",
    """SELECT lottery_id, draw_number, draw_date FROM draws WHERE NOT is_deleted
       ORDER BY draw_date DESC, draw_number LIMIT 50 OFFSET 100""",
)
def _(t):
    out = lookup.page_draws(t.draws.where("not is_deleted"), 3, 50, descending=True)
    return out.select("lottery_id", "draw_number", "draw_date")


@job("page_table", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 25")
def _(t):
    return lookup.page_table(t.raw("customer"), "c_custkey", 2, 25).select("c_custkey", "c_name")


@job(
    "find_draw",
    "SELECT lottery_id, draw_number, draw_date FROM draws WHERE lottery_id = 2 AND draw_number = 17",
)
def _(t):
    return lookup.find_draw(t.draws, 2, 17).select("lottery_id", "draw_number", "draw_date")


@job(
    "visible_draws",
    """edits AS (
         SELECT lottery_id, draw_number, 1 AS seq, true AS flag FROM draws WHERE winners IS NULL
         UNION ALL SELECT lottery_id, draw_number, 2, false FROM draws WHERE jackpot IS NULL),
       latest AS (
         SELECT lottery_id, draw_number, flag,
                row_number() OVER (PARTITION BY draw_number ORDER BY seq DESC) AS r FROM edits)
       SELECT d.lottery_id, d.draw_number FROM draws d
       LEFT JOIN latest l ON l.draw_number = d.draw_number AND l.r = 1
       WHERE NOT coalesce(l.flag, d.is_deleted)""",
)
def _(t):
    deleted = t.draws.where("winners is null").selectExpr(
        "lottery_id", "draw_number", "1 as seq", "true as is_deleted"
    )
    restored = t.draws.where("jackpot is null").selectExpr(
        "lottery_id", "draw_number", "2 as seq", "false as is_deleted"
    )
    return scan.visible_draws(deleted.unionByName(restored), t.draws).select(
        "lottery_id", "draw_number"
    )


@job("frequency", f"{FREQ} SELECT * FROM freq")
def _(t):
    return stats.frequency(t.numbers)


@job(
    "positional_frequency",
    "SELECT lottery_id, number, position, count(*) AS n FROM numbers GROUP BY 1, 2, 3",
)
def _(t):
    return stats.positional_frequency(t.numbers)


@job("gap_series", f"{GAPS} SELECT * FROM gap_rows WHERE gap IS NOT NULL")
def _(t):
    return stats.gap_series(t.baskets)


@job("gap_summary", f"{GAPS} SELECT * FROM gaps")
def _(t):
    return stats.gap_summary(t.baskets)


@job("null_aware_average", f"{AVERAGES} SELECT * FROM averages")
def _(t):
    return stats.null_aware_average(t.visible)


@job("entropy_base2", f"{FREQ}, {ENTROPY} SELECT * FROM entropies")
def _(t):
    return stats.entropy_base2(stats.frequency(t.numbers), t.lottery)


@job(
    "stats_snapshot",
    f"""{FREQ}, {GAPS}, {ENTROPY}, {AVERAGES},
    pos AS (SELECT lottery_id, number, position, count(*) AS n FROM numbers GROUP BY 1, 2, 3),
    scope AS (SELECT lottery_id, count(*) AS dc, min(draw_number) AS df, max(draw_number) AS dt
              FROM baskets GROUP BY 1)
    SELECT lottery_id, 'frequency' AS section, cast(number AS varchar) AS subject, 'count' AS metric,
           cast(n AS double) AS value FROM freq
    UNION ALL SELECT lottery_id, 'position', concat(number, '@', position), 'count', n FROM pos
    UNION ALL SELECT lottery_id, 'gap', cast(number AS varchar), 'count', gap_count FROM gaps
    UNION ALL SELECT lottery_id, 'gap', cast(number AS varchar), 'min', gap_min FROM gaps
    UNION ALL SELECT lottery_id, 'gap', cast(number AS varchar), 'max', gap_max FROM gaps
    UNION ALL SELECT lottery_id, 'gap', cast(number AS varchar), 'avg', gap_avg FROM gaps
    UNION ALL SELECT lottery_id, 'average', series, 'mean', mean FROM averages
    UNION ALL SELECT lottery_id, 'average', series, 'non_null', non_null FROM averages
    UNION ALL SELECT lottery_id, 'scalar', 'entropy', 'value', entropy FROM entropies
    UNION ALL SELECT lottery_id, 'scope', 'draws', 'draw_count', dc FROM scope
    UNION ALL SELECT lottery_id, 'scope', 'draws', 'draws_from', df FROM scope
    UNION ALL SELECT lottery_id, 'scope', 'draws', 'draws_to', dt FROM scope""",
)
def _(t):
    return stats.stats_snapshot(t.baskets, t.lottery)


@job("first_rows", f"{FREQ} SELECT * FROM freq ORDER BY number, lottery_id LIMIT 40")
def _(t):
    return lookup.first_rows(stats.frequency(t.numbers), 40, ["number", "lottery_id"])


@job(
    "hot_numbers",
    f"""{recent(100)} SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY lottery_id ORDER BY n DESC, number) AS rank FROM counts100)
    WHERE rank <= 5""",
)
def _(t):
    return lookup.hot_numbers(stats.last_n_counts(t.visible, 100))


@job(
    "cold_numbers",
    f"""{recent(100)} SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY lottery_id ORDER BY n, number) AS rank FROM counts100)
    WHERE rank <= 5""",
)
def _(t):
    return lookup.cold_numbers(stats.last_n_counts(t.visible, 100))


@job("last_n_counts", f"{recent(100)} SELECT * FROM counts100")
def _(t):
    return stats.last_n_counts(t.visible, 100)


@job(
    "rolling_trend",
    f"""{recent(100)},
    hot AS (SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY lottery_id ORDER BY n DESC, number) AS rank FROM counts100)
      WHERE rank <= 5),
    grid AS (
      SELECT r.lottery_id, r.draw_number, h.rank,
             sum(CASE WHEN m.number IS NULL THEN 0 ELSE 1 END)
               OVER (PARTITION BY r.lottery_id, h.rank ORDER BY r.draw_number) AS c
      FROM recent100 r JOIN hot h ON h.lottery_id = r.lottery_id
      LEFT JOIN members m ON m.draw_number = r.draw_number AND m.number = h.number
      WHERE r.newest <= 20)
    SELECT lottery_id, draw_number,
           {", ".join(f"cast(max(CASE WHEN rank = {r} THEN c END) AS bigint) AS hot_{r}" for r in range(1, 6))}
    FROM grid GROUP BY 1, 2""",
)
def _(t):
    hot = lookup.hot_numbers(stats.last_n_counts(t.visible, 100))
    return stats.rolling_trend(t.baskets, hot, 20)


@job(
    "hottest_coldest",
    f"""{FREQ}, r AS (
      SELECT *, row_number() OVER (PARTITION BY lottery_id ORDER BY n DESC, number) AS hi,
                row_number() OVER (PARTITION BY lottery_id ORDER BY n, number) AS lo FROM freq)
    SELECT lottery_id, max(CASE WHEN hi = 1 THEN number END) AS hottest, max(n) AS max_count,
           max(CASE WHEN lo = 1 THEN number END) AS coldest, min(n) AS min_count FROM r GROUP BY 1""",
)
def _(t):
    return stats.hottest_coldest(stats.frequency(t.numbers))


@job(
    "gap_extremes",
    f"""{GAPS}, r AS (
      SELECT *, row_number() OVER (PARTITION BY lottery_id ORDER BY gap_avg DESC, number) AS hi,
                row_number() OVER (PARTITION BY lottery_id ORDER BY gap_avg, number) AS lo
      FROM gaps WHERE gap_avg IS NOT NULL)
    SELECT lottery_id, max(CASE WHEN hi = 1 THEN number END) AS widest, max(gap_avg) AS widest_avg,
           max(CASE WHEN lo = 1 THEN number END) AS tightest, min(gap_avg) AS tightest_avg
    FROM r GROUP BY 1""",
)
def _(t):
    return stats.gap_extremes(stats.gap_summary(t.baskets))


@job(
    "dense_heatmap",
    f"""{PAIRS}, grid AS (
      SELECT lottery_id, cast(r AS int) AS "row", cast(c AS int) AS col
      FROM lottery, range(1, 46) x(r), range(1, 46) y(c)),
    ext AS (SELECT lottery_id, min(weight) AS lo, max(weight) AS hi FROM pairs GROUP BY 1)
    SELECT g.lottery_id, g."row", g.col, p.weight, e.lo AS min_weight, e.hi AS max_weight
    FROM grid g LEFT JOIN pairs p ON p.lottery_id = g.lottery_id
      AND p.a = least(g."row", g.col) AND p.b = greatest(g."row", g.col)
    JOIN ext e ON e.lottery_id = g.lottery_id""",
)
def _(t):
    return stats.dense_heatmap(graph.cooccurrence(t.baskets), t.lottery)


@job(
    "numeric_only",
    """SELECT lottery_id, row_number, try_cast(jackpot AS double) AS jackpot FROM raw_draws
       WHERE try_cast(jackpot AS double) IS NOT NULL AND isfinite(try_cast(jackpot AS double))""",
)
def _(t):
    return lookup.numeric_only(t.raw_draws.select("lottery_id", "row_number", "jackpot"), "jackpot")


@job(
    "sort_rows",
    "SELECT lottery_id, draw_number, jackpot FROM baskets ORDER BY jackpot DESC NULLS LAST, draw_number",
)
def _(t):
    rows = t.visible.select("lottery_id", "draw_number", "jackpot")
    return lookup.sort_rows(rows, "jackpot", "desc", tie="draw_number")
