"""Catalog: probability models."""

from __future__ import annotations

from pyspark.sql import functions as F

from urnframe.functions.columns import rounded
from urnframe.operators import lookup, probability
from urnframe.plans.catalog.statistics import FREQ, recent
from urnframe.plans.registry import job

# n over k through the log gamma function.
CHOOSE = """CASE WHEN {k} < 0 OR {k} > {n} THEN 0.0
  ELSE exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1)) END"""


def choose_sql(n: str, k: str) -> str:
    return CHOOSE.format(n=f"({n})", k=f"({k})")


EMPIRICAL = f"""{FREQ},
scope AS (SELECT lottery_id, count(*) AS draw_count FROM baskets GROUP BY 1),
empirical AS (
  SELECT f.lottery_id, f.number, f.n / s.draw_count AS value
  FROM freq f JOIN scope s ON s.lottery_id = f.lottery_id)"""
CONDITIONAL = f"""{recent(20)},
conditional AS (
  SELECT c.lottery_id, c.number, c.n / s.d AS value FROM counts20 c
  JOIN (SELECT lottery_id, count(*) AS d FROM recent20 GROUP BY 1) s ON s.lottery_id = c.lottery_id)"""
BAYES = f"""{EMPIRICAL}, {CONDITIONAL},
joint AS (
  SELECT coalesce(p.lottery_id, q.lottery_id) AS lottery_id, coalesce(p.number, q.number) AS number,
         coalesce(p.value, 0) * coalesce(q.value, 0) AS m
  FROM empirical p FULL JOIN conditional q ON q.lottery_id = p.lottery_id AND q.number = p.number),
bayes AS (
  SELECT lottery_id, number, m / t AS value
  FROM (SELECT *, sum(m) OVER (PARTITION BY lottery_id) AS t FROM joint) WHERE t <> 0)"""
MONTE_CARLO = """
sim_picks AS (
  SELECT lottery_id, number FROM (
    SELECT b.lottery_id, b.draw_number, u.n AS number, row_number() OVER (
      PARTITION BY b.lottery_id, b.draw_number
      ORDER BY md5(concat_ws('|', 7, b.lottery_id, b.draw_number, u.n)), u.n) AS r
    FROM baskets b, range(1, 46) u(n)) WHERE r <= 4),
monte_carlo AS (
  SELECT l.lottery_id, cast(u.n AS int) AS number, coalesce(h.c, 0) / s.sims AS value
  FROM lottery l CROSS JOIN range(1, 46) u(n)
  JOIN (SELECT lottery_id, count(*) AS sims FROM baskets GROUP BY 1) s ON s.lottery_id = l.lottery_id
  LEFT JOIN (SELECT lottery_id, number, count(*) AS c FROM sim_picks GROUP BY 1, 2) h
    ON h.lottery_id = l.lottery_id AND h.number = u.n)"""
SIZES = "sizes AS (SELECT lottery_id, cast(c AS int) AS good, count(*) AS draws FROM (SELECT lottery_id, draw_number, count(*) AS c FROM numbers GROUP BY 1, 2) GROUP BY 1, 2)"


@job(
    "hypergeometric",
    f"""{SIZES} SELECT lottery_id, good, draws, cast(k AS int) AS k,
          round(({choose_sql("good", "k")}) * ({choose_sql("45 - good", "4 - k")}) / {choose_sql("45", "4")}, 6)
            AS probability
        FROM sizes, range(0, 5) r(k)""",
)
def _(t):
    """Hits of a 4-number pick against every basket size that occurs."""
    sizes = t.baskets.groupBy("lottery_id", F.size("numbers").alias("good")).agg(
        F.count("*").alias("draws")
    )
    rules = t.lottery.select(
        "lottery_id",
        (F.col("max_number") - F.col("min_number") + 1).alias("pool"),
        F.col("numbers_to_select").alias("picks"),
    )
    out = probability.hypergeometric(sizes.join(rules, "lottery_id"))
    return out.select("lottery_id", "good", "draws", "k", rounded("probability").alias("probability"))


@job(
    "binomial",
    f"""p AS (SELECT lottery_id, count(*) / count(DISTINCT draw_number) / 45 AS p FROM numbers GROUP BY 1)
    SELECT lottery_id, cast(k AS int) AS k,
           round({choose_sql("10", "k")} * pow(p, k) * pow(1 - p, 10 - k), 6) AS probability
    FROM p, range(0, 11) r(k)""",
)
def _(t):
    """Appearances of a number in ten draws at the lottery's mean hit rate."""
    params = t.baskets.groupBy("lottery_id").agg(
        F.lit(10).alias("trials"), (F.sum(F.size("numbers")) / F.count("*") / 45).alias("p")
    )
    out = probability.binomial(params)
    return out.select("lottery_id", "k", rounded("probability").alias("probability"))


@job(
    "poisson",
    """rate AS (SELECT lottery_id, avg(winners) AS lam FROM baskets GROUP BY 1)
    SELECT lottery_id, cast(k AS int) AS k,
           round(exp(-lam) * pow(lam, k) / exp(lgamma(k + 1)), 6) AS probability
    FROM rate, range(0, 11) r(k)""",
)
def _(t):
    params = t.baskets.groupBy("lottery_id").agg(
        F.avg("winners").alias("lam"), F.lit(10).alias("kmax")
    )
    out = probability.poisson(params)
    return out.select("lottery_id", "k", rounded("probability").alias("probability"))


@job("empirical", f"{EMPIRICAL} SELECT lottery_id, number, round(value, 6) AS value FROM empirical")
def _(t):
    return probability.empirical(t.baskets).withColumn("value", rounded("value"))


@job("monte_carlo", f"{MONTE_CARLO} SELECT lottery_id, number, round(value, 6) AS value FROM monte_carlo")
def _(t):
    sims = t.baskets.select("lottery_id", F.col("draw_number").alias("sim"))
    return probability.monte_carlo(sims, t.lottery, seed=7).withColumn("value", rounded("value"))


@job(
    "nearest_rank_percentile",
    """SELECT lottery_id, p AS percentile, min(jackpot) AS value FROM (
      SELECT lottery_id, jackpot, row_number() OVER (PARTITION BY lottery_id ORDER BY jackpot) AS r,
             count(*) OVER (PARTITION BY lottery_id) AS n FROM baskets WHERE jackpot IS NOT NULL),
      (VALUES (50), (90), (99)) q(p)
    WHERE r >= greatest(ceil(p * n / 100), 1) GROUP BY 1, 2""",
)
def _(t):
    return probability.nearest_rank_percentile(t.baskets, ["lottery_id"], "jackpot")


@job("bayes_posterior", f"{BAYES} SELECT lottery_id, number, round(value, 6) AS value FROM bayes")
def _(t):
    out = probability.bayes_posterior(
        probability.empirical(t.baskets), probability.conditional(t.baskets)
    )
    return out.withColumn("value", rounded("value"))


@job("conditional", f"{CONDITIONAL} SELECT lottery_id, number, round(value, 6) AS value FROM conditional")
def _(t):
    return probability.conditional(t.baskets).withColumn("value", rounded("value"))


STORED = ["empirical", "conditional", "bayes", "hypergeometric"]  # models that read the draws; simulation is for the library alone
PROB_VALUES = f"""{BAYES},
prob_rows AS (
  SELECT lottery_id, 'empirical' AS model_id, cast(number AS varchar) AS subject, value FROM empirical
  UNION ALL SELECT lottery_id, 'conditional', cast(number AS varchar), value FROM conditional
  UNION ALL SELECT lottery_id, 'bayes', cast(number AS varchar), value FROM bayes
  UNION ALL SELECT lottery_id, 'hypergeometric', cast(k AS varchar),
    ({choose_sql("4", "k")}) * ({choose_sql("41", "4 - k")}) / {choose_sql("45", "4")} FROM lottery, range(0, 5) r(k))"""


@job(
    "prob_values",
    f"{PROB_VALUES} SELECT lottery_id, model_id, subject, round(round(value, 8), 6) AS value FROM prob_rows",
)
def _(t):
    return probability.prob_values(t.baskets, t.lottery, STORED).withColumn("value", rounded("value"))


@job(
    "read_prob_values",
    f"""{PROB_VALUES} SELECT lottery_id, model_id, subject, round(round(value, 8), 6) AS value FROM prob_rows
        WHERE model_id = 'bayes' AND subject = '7'""",
)
def _(t):
    values = probability.prob_values(t.baskets, t.lottery, ["bayes"])
    out = lookup.read_prob_values(values, "bayes", "7")
    return out.withColumn("value", rounded("value"))


@job(
    "number_distribution",
    f"{EMPIRICAL} SELECT lottery_id, number, round(round(value, 8), 6) AS probability FROM empirical",
)
def _(t):
    values = probability.prob_values(t.baskets, t.lottery, ["empirical"])
    out = probability.number_distribution(values)
    return out.withColumn("probability", rounded("probability"))
