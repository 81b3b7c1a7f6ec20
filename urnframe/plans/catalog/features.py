"""Catalog: per-draw features."""

from __future__ import annotations

from pyspark.sql import functions as F

from urnframe.functions.columns import rounded
from urnframe.operators import feature_graph, features, graph, lookup, stats
from urnframe.plans.catalog.statistics import FREQ, PAIRS
from urnframe.plans.registry import job

BASKET = """
basket AS (
  SELECT n.lottery_id, n.draw_number, sum(number) AS s, count(*) AS c, max(number) - min(number) AS r,
         count(*) FILTER (number % 2 = 1) AS odd, count(*) FILTER (number <= 23) AS low
  FROM numbers n GROUP BY 1, 2),
steps AS (
  SELECT lottery_id, draw_number,
         count(*) FILTER (number - prev = 1) AS consecutive
  FROM (SELECT *, lag(number) OVER (PARTITION BY draw_number ORDER BY number) AS prev FROM numbers)
  GROUP BY 1, 2)"""
REPEATED = """
prev_draw AS (
  SELECT lottery_id, draw_number, lag(draw_number) OVER (PARTITION BY lottery_id ORDER BY draw_number) AS prev
  FROM baskets),
repeated AS (
  SELECT p.lottery_id, p.draw_number, count(b.number) AS repeated_from_previous
  FROM prev_draw p JOIN members a ON a.draw_number = p.draw_number
  LEFT JOIN members b ON b.draw_number = p.prev AND b.number = a.number GROUP BY 1, 2)"""
MAX_GAP = """
universe AS (SELECT b.lottery_id, b.draw_number, cast(u.n AS int) AS number FROM baskets b, range(1, 46) u(n)),
last_seen AS (
  SELECT u.lottery_id, u.draw_number, u.number,
         max(CASE WHEN m.number IS NOT NULL THEN u.draw_number END)
           OVER (PARTITION BY u.lottery_id, u.number ORDER BY u.draw_number) AS seen,
         min(u.draw_number) OVER (PARTITION BY u.lottery_id) AS first
  FROM universe u LEFT JOIN members m ON m.draw_number = u.draw_number AND m.number = u.number),
max_gap AS (
  SELECT lottery_id, draw_number, max(draw_number - coalesce(seen, first)) AS max_current_gap
  FROM last_seen GROUP BY 1, 2)"""
FEATURES = f"""{BASKET}, {REPEATED}, {MAX_GAP},
feature_frame AS (
  SELECT b.lottery_id, b.draw_number, cast(s AS double) AS draw_sum, s / c AS draw_mean,
         cast(r AS double) AS draw_range,
         CASE WHEN c = odd THEN odd ELSE odd / (c - odd) END AS odd_even_ratio,
         CASE WHEN c = low THEN low ELSE low / (c - low) END AS low_high_ratio,
         cast(consecutive AS double) AS consecutive_count,
         cast(repeated_from_previous AS double) AS repeated_from_previous,
         cast(max_current_gap AS double) AS max_current_gap
  FROM basket b JOIN steps USING (lottery_id, draw_number) JOIN repeated USING (lottery_id, draw_number)
  JOIN max_gap USING (lottery_id, draw_number)),
feature_rows AS (
  SELECT feature_id, 1 AS version, lottery_id, draw_number, round(value, 8) AS value
  FROM feature_frame UNPIVOT (value FOR feature_id IN ({", ".join(features.FEATURE_ORDER)})))"""
GRID = """
seen AS (SELECT DISTINCT lottery_id, number FROM numbers),
grid AS (
  SELECT b.lottery_id, b.draw_number, b.idx, s.number, m.number IS NOT NULL AS hit,
         count(m.number) OVER (PARTITION BY b.lottery_id, s.number ORDER BY b.draw_number) AS frequency
  FROM baskets b JOIN seen s ON s.lottery_id = b.lottery_id
  LEFT JOIN members m ON m.draw_number = b.draw_number AND m.number = s.number)"""


def _basket_job(name: str, expr: str) -> None:
    @job(
        name,
        f"{BASKET} SELECT b.lottery_id, b.draw_number, {expr} AS {name} "
        "FROM basket b JOIN steps USING (lottery_id, draw_number)",
    )
    def _(t):
        return features.basket_features(t.visible, t.lottery, [name]).withColumn(
            name, rounded(F.col(name).cast("double"))
        )


for _name, _expr in {
    "draw_sum": "cast(s AS double)",
    "draw_mean": "round(s / c, 6)",
    "draw_range": "cast(r AS double)",
    "odd_even_ratio": "round(CASE WHEN c = odd THEN odd ELSE odd / (c - odd) END, 6)",
    "low_high_ratio": "round(CASE WHEN c = low THEN low ELSE low / (c - low) END, 6)",
    "consecutive_count": "cast(consecutive AS double)",
}.items():
    _basket_job(_name, _expr)


@job(
    "decade_distribution",
    """SELECT lottery_id, draw_number, cast((number - 1) // 10 * 10 + 1 AS int) AS band, count(*) AS n
       FROM numbers GROUP BY 1, 2, 3""",
)
def _(t):
    out = features.decade_distribution(t.visible)
    return out.select("lottery_id", "draw_number", F.explode("decades").alias("band", "n"))


@job("repeated_from_previous", f"{REPEATED} SELECT * FROM repeated")
def _(t):
    return features.repeated_from_previous(t.baskets)


@job("max_current_gap", f"{MAX_GAP} SELECT * FROM max_gap")
def _(t):
    return features.max_current_gap(t.baskets, t.lottery)


@job(
    "current_frequency",
    f"{GRID} SELECT lottery_id, draw_number, number, frequency FROM grid WHERE frequency > 0",
)
def _(t):
    return features.current_frequency(t.baskets)


@job(
    "current_frequency_map",
    f"""{GRID} SELECT lottery_id, draw_number,
          string_agg(concat(number, ':', frequency), ',' ORDER BY number) AS frequencies
        FROM grid WHERE frequency > 0 GROUP BY 1, 2""",
)
def _(t):
    out = features.current_frequency_map(t.baskets)
    text = F.transform(
        F.map_entries("current_frequency"),
        lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string")),
    )
    return out.select("lottery_id", "draw_number", F.array_join(text, ",").alias("frequencies"))


@job("feature_values", f"{FEATURES} SELECT * FROM feature_rows")
def _(t):
    return features.feature_values(features.feature_frame(t.baskets, t.lottery))


@job(
    "feature_matrix",
    f"""{FEATURES} SELECT lottery_id, draw_number,
        {", ".join(f"round({c}, 8) AS {c}" for c in features.FEATURE_ORDER)} FROM feature_frame""",
)
def _(t):
    frame = features.feature_frame(t.baskets, t.lottery)
    return features.feature_matrix(features.feature_values(frame))


@job(
    "read_features",
    f"""{BASKET} SELECT 'draw_sum' AS feature_id, 1 AS version, lottery_id, draw_number,
          cast(s AS double) AS value FROM basket ORDER BY lottery_id, draw_number LIMIT 500""",
)
def _(t):
    long = features.feature_values(features.basket_features(t.baskets, t.lottery))
    return lookup.read_features(long, "draw_sum", 500)


@job(
    "draw_correlation",
    f"""{FREQ}, {PAIRS}, scope AS (SELECT lottery_id, count(*) AS n FROM baskets GROUP BY 1)
    SELECT x.lottery_id, x.number AS a, y.number AS b,
           round((s.n * coalesce(p.weight, 0)::double - x.n::double * y.n)
                 / sqrt(x.n::double * (s.n - x.n) * y.n * (s.n - y.n)), 6) AS correlation
    FROM freq x JOIN freq y ON x.lottery_id = y.lottery_id AND x.number < y.number
    JOIN scope s ON s.lottery_id = x.lottery_id
    LEFT JOIN pairs p ON p.lottery_id = x.lottery_id AND p.a = x.number AND p.b = y.number""",
)
def _(t):
    out = features.draw_correlation(
        stats.frequency(t.numbers), graph.cooccurrence(t.baskets), stats.draw_scope(t.baskets)
    )
    return out.withColumn("correlation", rounded("correlation"))


@job(
    "feature_registry",
    f"""{BASKET}, changed AS (
      SELECT lottery_id, draw_number, s, r, c, s - lag(s) OVER (PARTITION BY lottery_id ORDER BY draw_number) AS sum_change FROM basket)
    SELECT lottery_id, draw_number, r AS draw_range, sum_change, round(sum_change / s, 12) AS change_share,
           round(sum_change / s / CASE WHEN r <> 0 THEN r END, 12) AS change_by_range FROM changed""",
)
def _(t):
    """Features that build on others: registered in any order, built in the order of their needs."""
    own = feature_graph.standard()
    own.add("change_by_range", feature_graph.share_of("change_share", "draw_range"), ["change_share", "draw_range"])
    own.add("change_share", feature_graph.share_of("sum_change", "draw_sum"), ["sum_change", "draw_sum"])
    own.add("sum_change", feature_graph.change_of("draw_sum", "sum_change"), ["draw_sum"], series=True)
    out = own.frame(t.baskets, t.lottery, ["draw_range", "sum_change", "change_share", "change_by_range"])
    return out.withColumn("change_share", rounded("change_share", 12)).withColumn("change_by_range", rounded("change_by_range", 12))
