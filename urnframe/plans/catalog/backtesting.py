"""Catalog: walk-forward backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from urnframe.functions.columns import rounded
from urnframe.operators import backtest, training
from urnframe.plans.registry import job

YEARS, EVAL_COUNT, STEP, SEED = 2, 30, 30, 11

DAYS = f"""
days AS (
  SELECT lottery_id, draw_number, draw_date,
         row_number() OVER (PARTITION BY lottery_id ORDER BY draw_date, draw_number) - 1 AS idx,
         date_diff('day', lag(draw_date) OVER (PARTITION BY lottery_id ORDER BY draw_date, draw_number), draw_date) AS gap
  FROM baskets),
day_ends AS (SELECT lottery_id, draw_date, max(idx) + 1 AS day_to FROM days GROUP BY 1, 2),
train_counts AS (
  SELECT lottery_id, count(*) AS draws,
         cast(greatest(floor({YEARS * 365} / CASE WHEN median(gap) <= 0 THEN 1 ELSE median(gap) END), 1) AS bigint) AS train_count
  FROM days GROUP BY 1),
windows AS (
  SELECT c.lottery_id, s // {STEP} AS "window", s AS train_from, e.day_to AS eval_from, e.day_to + {EVAL_COUNT} AS eval_to
  FROM train_counts c, LATERAL (SELECT unnest(range(0, draws, {STEP})) AS s)
  JOIN days d ON d.lottery_id = c.lottery_id AND d.idx = s + train_count - 1
  JOIN day_ends e ON e.lottery_id = d.lottery_id AND e.draw_date = d.draw_date
  WHERE e.day_to + {EVAL_COUNT} <= c.draws),
evals AS (
  SELECT w.lottery_id, w."window", d.draw_number, d.idx
  FROM windows w JOIN days d ON d.lottery_id = w.lottery_id AND d.idx >= w.eval_from AND d.idx < w.eval_to)"""
BENCH_PICKS = f"""
uniform_picks AS (
  SELECT lottery_id, "window", draw_number, number FROM (
    SELECT e.*, u.n AS number, row_number() OVER (PARTITION BY e.lottery_id, e."window", e.draw_number
      ORDER BY md5(concat_ws('|', {SEED}, e.lottery_id, e."window", e.draw_number, u.n)), u.n) AS r
    FROM evals e, range(1, 46) u(n)) WHERE r <= 5),
hyper_draws AS (
  SELECT e.*, u.i, cast('0x' || substr(md5(concat_ws('|', {SEED}, e.lottery_id, e."window", e.draw_number, u.i)), 1, 8)
                        AS bigint) % 45 + 1 AS number
  FROM evals e, range(1, 6) u(i)),
bench_picks AS (
  SELECT 'static' AS predictor, lottery_id, "window", draw_number, u.n AS number FROM evals, range(1, 6) u(n)
  UNION ALL SELECT 'uniform', lottery_id, "window", draw_number, number FROM uniform_picks
  UNION ALL SELECT DISTINCT 'hypergeometric', lottery_id, "window", draw_number, number FROM hyper_draws)"""
BASE_PICKS = """
trained AS (
  SELECT w.lottery_id, w."window", m.number, count(*) AS n
  FROM windows w
  JOIN days d ON d.lottery_id = w.lottery_id AND d.idx >= w.train_from AND d.idx < w.eval_from
  JOIN members m ON m.draw_number = d.draw_number GROUP BY 1, 2, 3),
train_counts_by AS (
  SELECT w.lottery_id, w."window", u.n AS number, coalesce(t.n, 0) AS n
  FROM windows w CROSS JOIN range(1, 46) u(n)
  LEFT JOIN trained t ON t.lottery_id = w.lottery_id AND t."window" = w."window" AND t.number = u.n),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lottery_id, "window" ORDER BY n DESC, number) AS hi,
         row_number() OVER (PARTITION BY lottery_id, "window" ORDER BY n, number) AS lo FROM train_counts_by),
base_picks AS (
  SELECT 'most_frequent' AS predictor, e.lottery_id, e."window", e.draw_number, r.number
  FROM evals e JOIN ranked r ON r.lottery_id = e.lottery_id AND r."window" = e."window" AND r.hi <= 5
  UNION ALL
  SELECT 'least_frequent', e.lottery_id, e."window", e.draw_number, r.number
  FROM evals e JOIN ranked r ON r.lottery_id = e.lottery_id AND r."window" = e."window" AND r.lo <= 5
  UNION ALL
  SELECT 'last_numbers', e.lottery_id, e."window", e.draw_number, m.number
  FROM evals e JOIN windows w ON w.lottery_id = e.lottery_id AND w."window" = e."window"
  JOIN days d ON d.lottery_id = w.lottery_id AND d.idx = w.eval_from - 1
  JOIN members m ON m.draw_number = d.draw_number)"""


def match_sql(picks: str) -> str:
    return f"""
matched AS (
  SELECT p.predictor, p.lottery_id, p."window", p.draw_number, count(m.number) AS matches
  FROM {picks} p LEFT JOIN members m ON m.draw_number = p.draw_number AND m.number = p.number
  GROUP BY 1, 2, 3, 4),
per_window AS (
  SELECT lottery_id, predictor, "window", round(avg(cast(matches >= 1 AS int)), 8) AS hit_rate,
         round(avg(matches), 8) AS average_matches, round(stddev_pop(matches), 8) AS consistency_score,
         count(*) AS draws_evaluated
  FROM matched GROUP BY 1, 2, 3),
per_predictor AS (
  SELECT lottery_id, predictor, round(sum(hit_rate * draws_evaluated) / sum(draws_evaluated), 6) AS hit_rate,
         round(sum(average_matches * draws_evaluated) / sum(draws_evaluated), 6) AS average_matches,
         round(sqrt(sum(consistency_score * consistency_score * draws_evaluated) / sum(draws_evaluated)), 6)
           AS consistency_score,
         cast(sum(draws_evaluated) AS bigint) AS draws_evaluated, count(*) AS windows
  FROM per_window GROUP BY 1, 2)"""


BENCH = f"{DAYS}, {BENCH_PICKS}, {match_sql('bench_picks')}"
WINDOW_COLUMNS = """lottery_id, predictor, "window", round(hit_rate, 6) AS hit_rate,
  round(average_matches, 6) AS average_matches, round(consistency_score, 6) AS consistency_score, draws_evaluated"""


def planned(t):
    return backtest.plan_windows(t.dated_draws, YEARS, EVAL_COUNT, STEP)


def evals(t):
    indexed, windows = planned(t)
    return backtest.evaluation_rows(windows, indexed)


def matched(t):
    return backtest.match_counts(backtest.predictions(evals(t), t.lottery, SEED))


def six(df):
    return df.select(
        *[rounded(c).alias(c) if c in backtest.METRICS else F.col(c) for c in df.columns]
    )


def text(c: str):
    return F.array_join(F.col(c).cast("array<string>"), ",")


@job("train_count", f"{DAYS} SELECT * FROM train_counts")
def _(t):
    return backtest.train_count(t.dated_draws, YEARS)


@job("walk_forward_windows", f"{DAYS} SELECT * FROM windows")
def _(t):
    return planned(t)[1]


@job(
    "check_window_order",
    f"""{DAYS} SELECT w.lottery_id, w."window", a.draw_date AS train_to, b.draw_date AS eval_start
        FROM windows w JOIN days a ON a.lottery_id = w.lottery_id AND a.idx = w.eval_from - 1
        JOIN days b ON b.lottery_id = w.lottery_id AND b.idx = w.eval_from""",
)
def _(t):
    indexed, windows = planned(t)
    return backtest.check_window_order(backtest.window_order(windows, indexed))


@job("check_data_floor", f"{DAYS} SELECT * FROM train_counts")
def _(t):
    return backtest.check_data_floor(backtest.train_count(t.dated_draws, YEARS), 100)


@job(
    "static_strategy",
    f"""{DAYS} SELECT lottery_id, "window", draw_number, '1,2,3,4,5' AS picks FROM evals""",
)
def _(t):
    rows = evals(t).select(*backtest.EVAL, backtest.static_picks().alias("picks"))
    return rows.withColumn("picks", text("picks"))


@job(
    "uniform_benchmark",
    f"""{DAYS}, {BENCH_PICKS} SELECT lottery_id, "window", draw_number,
          string_agg(cast(number AS varchar), ',' ORDER BY number) AS picks FROM uniform_picks GROUP BY 1, 2, 3""",
)
def _(t):
    out = backtest.uniform_benchmark(evals(t), t.lottery, SEED)
    return out.withColumn("picks", text("picks"))


@job(
    "hypergeometric_benchmark",
    f"""{DAYS}, {BENCH_PICKS} SELECT lottery_id, "window", draw_number,
          string_agg(cast(number AS varchar), ',' ORDER BY number) AS picks FROM hyper_draws GROUP BY 1, 2, 3""",
)
def _(t):
    out = backtest.hypergeometric_benchmark(evals(t), t.lottery, SEED)
    return out.withColumn("picks", text("picks"))


@job(
    "strategy_model",
    """grid AS (
      SELECT b.lottery_id, b.draw_number, b.idx, s.number,
             count(m.number) OVER (PARTITION BY b.lottery_id, s.number ORDER BY b.draw_number) AS f
      FROM baskets b JOIN (SELECT DISTINCT lottery_id, number FROM numbers) s ON s.lottery_id = b.lottery_id
      LEFT JOIN members m ON m.draw_number = b.draw_number AND m.number = s.number),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY draw_number ORDER BY f / (idx + 1) DESC, number) AS r,
             max(idx) OVER (PARTITION BY lottery_id) AS last_idx FROM grid)
    SELECT lottery_id, draw_number, string_agg(cast(number AS varchar), ',' ORDER BY number) AS picks
    FROM ranked WHERE r <= 5 AND idx < last_idx GROUP BY 1, 2""",
)
def _(t):
    out = backtest.strategy_model(training.frequency_scores(t.baskets), 5)
    return out.withColumn("picks", text("picks"))


@job(
    "match_counts",
    f'{BENCH} SELECT predictor, lottery_id, "window", draw_number, matches FROM matched',
)
def _(t):
    return matched(t).select("predictor", *backtest.EVAL, "matches")


@job("window_metrics", f"{BENCH} SELECT {WINDOW_COLUMNS} FROM per_window")
def _(t):
    return six(backtest.window_metrics(matched(t)))


@job(
    "match_distribution",
    f"{BENCH} SELECT lottery_id, predictor, matches, count(*) AS n FROM matched GROUP BY 1, 2, 3",
)
def _(t):
    return backtest.match_distribution(matched(t))


@job("aggregate_windows", f"{BENCH} SELECT * FROM per_predictor")
def _(t):
    return six(backtest.aggregate_windows(backtest.window_metrics(matched(t))))


ALL_PICKS = """
all_picks AS (SELECT * FROM bench_picks UNION ALL SELECT * FROM base_picks)"""
BACKTEST = f"{DAYS}, {BENCH_PICKS}, {BASE_PICKS}, {ALL_PICKS}, {match_sql('all_picks')}"


@job("backtest", f"{BACKTEST} SELECT {WINDOW_COLUMNS} FROM per_window")
def _(t):
    return six(backtest.backtest(t.dated_draws, t.lottery, YEARS, EVAL_COUNT, STEP, SEED))


@job(
    "baseline_strategies",
    f"""{DAYS}, {BASE_PICKS} SELECT predictor, lottery_id, "window", draw_number,
          string_agg(cast(number AS varchar), ',' ORDER BY number) AS picks FROM base_picks GROUP BY 1, 2, 3, 4""",
)
def _(t):
    indexed, windows = planned(t)
    rows = backtest.evaluation_rows(windows, indexed)
    out = backtest.baseline_predictions(rows, windows, indexed, t.lottery)
    return out.select("predictor", *backtest.EVAL, text("picks").alias("picks"))


VERSIONED = """
versioned AS (SELECT lottery_id, predictor, "window" AS version, round(hit_rate, 6) AS hit_rate FROM per_window)"""


def versioned(t):
    rows = backtest.window_metrics(matched(t))
    return rows.select(
        "lottery_id", "predictor", F.col("window").alias("version"), rounded("hit_rate").alias("hit_rate")
    )


@job("backtest_history", f"{BENCH}, {VERSIONED} SELECT * FROM versioned WHERE lottery_id = 2")
def _(t):
    return backtest.backtest_history(versioned(t), 2)


@job(
    "backtest_results",
    f"""{BENCH}, {VERSIONED} SELECT lottery_id, predictor, version, hit_rate FROM (
      SELECT *, row_number() OVER (PARTITION BY lottery_id, predictor ORDER BY version DESC) AS r FROM versioned)
    WHERE r = 1""",
)
def _(t):
    return backtest.backtest_results(versioned(t))
