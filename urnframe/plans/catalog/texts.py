"""Catalog: text columns and the further statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from urnframe.functions.columns import rounded
from urnframe.operators import extras, features, probability, stats, text, training
from urnframe.plans.catalog.features import BASKET, FEATURES
from urnframe.plans.catalog.probability import EMPIRICAL
from urnframe.plans.catalog.statistics import AVERAGES, ENTROPY, GAPS
from urnframe.plans.registry import job
from urnframe.session import checkpoint_frame


def _plain(c: str) -> str:
    return f"regexp_replace(cast(cast({c} AS decimal(20,6)) AS varchar), '\\.?0+$', '')"


def six(df, *names):
    return df.select(*[rounded(c).alias(c) if c in names else F.col(c) for c in df.columns])


@job("fold_text", "SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", text.fold_text(F.col("text")).alias("folded"))


def _intent_sql() -> str:
    cases = " ".join(
        f"WHEN {' OR '.join(f'''contains(f, '{w}')''' for w in words)} THEN '{intent}'"
        for intent, words in text.INTENTS
    )
    return f"""folded AS (SELECT conv_id, turn, role, strip_accents(lower(text)) AS f FROM conversations)
    SELECT conv_id, turn, role, CASE {cases} ELSE 'unknown' END AS intent FROM folded"""


@job("classify_intent", _intent_sql())
def _(t):
    intent = text.classify_intent(F.col("text")).alias("intent")
    return t.raw("conversations").select("conv_id", "turn", "role", intent)


LINES = f"""{EMPIRICAL}, {GAPS}, {AVERAGES},
lines AS (
  SELECT lottery_id, 1 AS section_no, 'frequency' AS section, lpad(cast(number AS varchar), 10, '0') AS sort_key,
         concat('- ', number, ': ', n) AS line FROM freq
  UNION ALL SELECT lottery_id, 2, 'gap', lpad(cast(number AS varchar), 10, '0'),
         concat('- ', number, ': promedio ', coalesce({_plain("gap_avg")}, 'sin datos')) FROM gaps
  UNION ALL SELECT lottery_id, 3, 'average', series, concat('- ', series, ': ', coalesce({_plain("mean")}, 'sin datos')) FROM averages
  UNION ALL SELECT lottery_id, 4, 'probability', concat('empirical|', number),
         concat('- empirical (', number, '): ', {_plain("round(value, 8)")}) FROM empirical)"""


def lines(t):
    return text.report_lines(
        stats.frequency(t.numbers),
        stats.gap_summary(t.baskets),
        stats.null_aware_average(t.visible),
        probability.prob_values(t.baskets, t.lottery, ["empirical"]),
    )


@job("report_lines", f"{LINES} SELECT * FROM lines")
def _(t):
    return lines(t)


@job(
    "report_text",
    f"""{LINES} SELECT lottery_id, section_no, concat(
          CASE section WHEN 'frequency' THEN '## Frecuencias' WHEN 'gap' THEN '## Huecos'
            WHEN 'average' THEN '## Promedios' ELSE '## Probabilidades' END,
          chr(10), string_agg(line, chr(10) ORDER BY sort_key)) AS body FROM lines GROUP BY 1, 2, section""",
)
def _(t):
    return text.report_text(lines(t))


@job(
    "explain_sentence",
    f"""{EMPIRICAL}, {GAPS}, {AVERAGES}, {ENTROPY},
    hot AS (
      SELECT lottery_id, max(CASE WHEN hi = 1 THEN number END) AS hottest, max(n) AS max_count,
             max(CASE WHEN lo = 1 THEN number END) AS coldest, min(n) AS min_count
      FROM (SELECT *, row_number() OVER (PARTITION BY lottery_id ORDER BY n DESC, number) AS hi,
                   row_number() OVER (PARTITION BY lottery_id ORDER BY n, number) AS lo FROM freq) GROUP BY 1),
    wide AS (
      SELECT lottery_id, max(CASE WHEN hi = 1 THEN number END) AS widest, max(gap_avg) AS widest_avg,
             max(CASE WHEN lo = 1 THEN number END) AS tightest, min(gap_avg) AS tightest_avg
      FROM (SELECT *, row_number() OVER (PARTITION BY lottery_id ORDER BY gap_avg DESC, number) AS hi,
                   row_number() OVER (PARTITION BY lottery_id ORDER BY gap_avg, number) AS lo
            FROM gaps WHERE gap_avg IS NOT NULL) GROUP BY 1)
    SELECT l.lottery_id, concat('Lottery ', code, ': drawn most ', hottest, ' (', max_count, ' times), drawn least ', coldest,
      ' (', min_count, ' times)', '; longest mean gap ', widest, ' (', {_plain("widest_avg")}, '), shortest ', tightest, ' (',
      {_plain("tightest_avg")}, ')', '; mean jackpot ', {_plain("mean")}, '; entropy ', {_plain("entropy")}, ' bits.') AS sentence
    FROM lottery l JOIN hot h ON h.lottery_id = l.lottery_id JOIN wide w ON w.lottery_id = l.lottery_id
    JOIN averages a ON a.lottery_id = l.lottery_id AND a.series = 'jackpot' JOIN entropies e ON e.lottery_id = l.lottery_id""",
)
def _(t):
    counts = stats.frequency(t.numbers)
    return text.explain_sentence(
        t.lottery,
        stats.hottest_coldest(counts),
        stats.gap_extremes(stats.gap_summary(t.baskets)),
        stats.null_aware_average(t.visible),
        stats.entropy_base2(counts, t.lottery),
    )


@job(
    "frequency_last",
    """newest AS (SELECT lottery_id, draw_number, row_number() OVER (PARTITION BY lottery_id ORDER BY draw_number DESC) AS r FROM baskets)
    SELECT n.lottery_id, m.number, count(*) FILTER (r <= 10) AS last_10, count(*) FILTER (r <= 25) AS last_25,
           count(*) FILTER (r <= 50) AS last_50, count(*) FILTER (r <= 100) AS last_100
    FROM newest n JOIN members m ON m.draw_number = n.draw_number WHERE r <= 100 GROUP BY 1, 2""",
)
def _(t):
    return extras.frequency_last(t.visible)


@job(
    "number_state",
    """seen AS (
      SELECT n.lottery_id, n.number, b.idx, b.idx - row_number() OVER (PARTITION BY n.lottery_id, n.number ORDER BY b.idx) AS island
      FROM numbers n JOIN baskets b ON b.draw_number = n.draw_number),
    islands AS (SELECT lottery_id, number, island, count(*) AS n, min(idx) AS lo, max(idx) AS hi FROM seen GROUP BY 1, 2, 3),
    size AS (SELECT lottery_id, max(idx) AS last FROM baskets GROUP BY 1)
    SELECT i.lottery_id, i.number, max(last) - min(lo) AS age, max(last) - max(hi) AS current_gap, max(n) AS longest_streak
    FROM islands i JOIN size s ON s.lottery_id = i.lottery_id GROUP BY 1, 2""",
)
def _(t):
    return extras.number_state(t.baskets)


@job(
    "member_counts",
    """SELECT lottery_id, draw_number,
      count(*) FILTER (number IN (2,3,5,7,11,13,17,19,23,29,31,37,41,43)) AS prime_count,
      count(*) FILTER (number IN (1,2,3,5,8,13,21,34)) AS fibonacci_count,
      count(*) FILTER (number % 3 = 0) AS multiples_of_3, count(*) FILTER (number % 5 = 0) AS multiples_of_5,
      count(*) FILTER (number <= 23) AS low_count, count(*) FILTER (number > 23) AS high_count
    FROM numbers GROUP BY 1, 2""",
)
def _(t):
    return extras.member_counts(t.visible, t.lottery)


STATE = """seen AS (
  SELECT n.lottery_id, n.number, b.idx, b.idx - row_number() OVER (PARTITION BY n.lottery_id, n.number ORDER BY b.idx) AS island
  FROM numbers n JOIN baskets b ON b.draw_number = n.draw_number),
islands AS (SELECT lottery_id, number, island, count(*) AS n, min(idx) AS lo, max(idx) AS hi FROM seen GROUP BY 1, 2, 3),
size AS (SELECT lottery_id, max(idx) AS last FROM baskets GROUP BY 1)"""


def _state_job(name: str, column: str, expr: str) -> None:
    @job(
        name,
        f"{STATE} SELECT i.lottery_id, i.number, {expr} AS {name} "
        "FROM islands i JOIN size s ON s.lottery_id = i.lottery_id GROUP BY 1, 2",
    )
    def _(t):
        out = extras.number_state(t.baskets)
        return out.select("lottery_id", "number", F.col(column).alias(name))


_state_job("number_age", "age", "max(last) - min(lo)")
_state_job("current_gap", "current_gap", "max(last) - max(hi)")
_state_job("streak", "longest_streak", "max(n)")


def _member_job(name: str, test: str) -> None:
    @job(
        name,
        f"SELECT lottery_id, draw_number, count(*) FILTER ({test}) AS {name} FROM numbers GROUP BY 1, 2",
    )
    def _(t):
        return extras.member_counts(t.visible, t.lottery).select("lottery_id", "draw_number", name)


for _name, _test in {
    "prime_count": "number IN (2,3,5,7,11,13,17,19,23,29,31,37,41,43)",
    "fibonacci_count": "number IN (1,2,3,5,8,13,21,34)",
    "multiples_of_3": "number % 3 = 0",
    "multiples_of_5": "number % 5 = 0",
    "low_count": "number <= 23",
    "high_count": "number > 23",
}.items():
    _member_job(_name, _test)


@job(
    "draw_shape",
    """m AS (
      SELECT lottery_id, draw_number, number, avg(number) OVER (PARTITION BY draw_number) AS mean FROM numbers)
    SELECT lottery_id, draw_number, median(number) AS median, min(number) AS mode, round(avg(pow(number - mean, 2)), 6) AS variance,
      round(sqrt(avg(pow(number - mean, 2))), 6) AS stddev,
      round(CASE WHEN count(*) = 1 THEN 0.0 ELSE avg(pow(number - mean, 3)) / pow(avg(pow(number - mean, 2)), 1.5) END, 6) AS skewness,
      round(CASE WHEN count(*) = 1 THEN 0.0 ELSE avg(pow(number - mean, 4)) / pow(avg(pow(number - mean, 2)), 2) - 3 END, 6) AS kurtosis,
      round(log2(count(*)), 6) AS entropy
    FROM m GROUP BY 1, 2""",
)
def _(t):
    return six(extras.draw_shape(t.visible), "variance", "stddev", "skewness", "kurtosis", "entropy")


@job(
    "position_stats",
    """rows AS (SELECT n.lottery_id, n.position, n.number, b.idx FROM numbers n JOIN baskets b ON b.draw_number = n.draw_number),
    e AS (
      SELECT lottery_id, position, sum(-p * log2(p)) AS entropy FROM (
        SELECT lottery_id, position, count(*) / sum(count(*)) OVER (PARTITION BY lottery_id, position) AS p
        FROM rows GROUP BY lottery_id, position, number) GROUP BY 1, 2)
    SELECT r.lottery_id, r.position, count(*) AS n, round(avg(number), 6) AS mean, round(stddev_pop(number), 6) AS stddev,
           round(regr_slope(number, idx), 6) AS trend, round(max(e.entropy), 6) AS entropy
    FROM rows r JOIN e ON e.lottery_id = r.lottery_id AND e.position = r.position GROUP BY 1, 2""",
)
def _(t):
    return six(extras.position_stats(t.baskets), "mean", "stddev", "trend", "entropy")


@job(
    "number_differences",
    """d AS (
      SELECT lottery_id, draw_number, number, row_number() OVER w - 1 AS step, lag(number) OVER w AS prev,
             min(number) OVER (PARTITION BY draw_number) AS lowest
      FROM numbers WINDOW w AS (PARTITION BY draw_number ORDER BY number))
    SELECT lottery_id, draw_number, step, number - prev AS difference, number - lowest AS distance FROM d WHERE prev IS NOT NULL""",
)
def _(t):
    return extras.number_differences(t.visible)


EMA = [0.2 * 0.8**k for k in range(10)]
EMA_SQL = " + ".join(f"coalesce(lag(s, {k}) OVER o, 0) * {w / sum(EMA)!r}::double" for k, w in enumerate(EMA))


@job(
    "series_indicators",
    f"""{BASKET}, x AS (
      SELECT b.lottery_id, b.draw_number, s, row_number() OVER (PARTITION BY b.lottery_id ORDER BY b.draw_number) AS i FROM basket b),
    w AS (
      SELECT lottery_id, draw_number, i, avg(s) OVER f AS sma, {EMA_SQL} AS ema, s - lag(s, 9) OVER o AS momentum,
             regr_slope(s, i) OVER f AS slope, s - 2 * lag(s, 1) OVER o + lag(s, 2) OVER o AS acceleration,
             stddev_pop(s) OVER f AS volatility
      FROM x WINDOW o AS (PARTITION BY lottery_id ORDER BY i),
                    f AS (PARTITION BY lottery_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
    SELECT lottery_id, draw_number, round(sma, 4) AS sma, round(ema, 4) AS ema, momentum, round(slope, 4) AS slope,
           acceleration, round(volatility, 4) AS volatility FROM w WHERE i >= 10""",
)
def _(t):
    sums = features.basket_features(t.baskets, t.lottery, ["draw_sum"])
    out = extras.series_indicators(sums, "draw_sum")
    for name in ("sma", "ema", "slope", "volatility"):
        out = out.withColumn(name, rounded(name, 4))
    return out


@job(
    "probability_bounds",
    f"""{EMPIRICAL} SELECT e.lottery_id, number, round(value, 6) AS probability,
          round(sum(value) OVER (PARTITION BY e.lottery_id ORDER BY number), 6) AS cumulative,
          round(greatest(value - 1.96 * sqrt(value * (1 - value) / draw_count), 0), 6) AS low,
          round(least(value + 1.96 * sqrt(value * (1 - value) / draw_count), 1), 6) AS high
        FROM empirical e JOIN scope s ON s.lottery_id = e.lottery_id""",
)
def _(t):
    out = extras.probability_bounds(probability.empirical(t.baskets), stats.draw_scope(t.baskets))
    return six(out, "probability", "cumulative", "low", "high")


SUPPORT = 0.0015


def _sets_sql(size: int) -> str:
    """Sets of ``size`` numbers of one draw, as their text and the texts of their parts."""
    names = [f"i{k}" for k in range(size)]
    joins = " ".join(
        f"JOIN numbers {b} ON {b}.draw_number = {a}.draw_number AND {b}.number > {a}.number" for a, b in zip(names, names[1:])
    )
    items = ", ".join(f"{n}.number" for n in names)
    return f"SELECT i0.lottery_id, [{items}] AS items, count(*) AS freq FROM numbers i0 {joins} GROUP BY ALL"


ITEMS = f"""
own AS (SELECT lottery_id, count(*) AS n, ceil({SUPPORT} * count(*)) AS least FROM baskets GROUP BY 1),
sets AS (
  SELECT s.lottery_id, items, freq FROM ({" UNION ALL ".join(_sets_sql(k) for k in range(1, 6))}) s
  JOIN own ON own.lottery_id = s.lottery_id AND freq >= least)"""


def _named(column: str):
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", "lottery_id", x)), " ")


@job(
    "frequent_itemsets",
    f"{ITEMS} SELECT array_to_string(list_transform(items, lambda x: concat(lottery_id, ':', x)), ' ') AS items, freq FROM sets",
)
def _(t):
    return extras.frequent_itemsets(t.baskets, SUPPORT).select(_named("items").alias("items"), "freq")


@job(
    "association_rules",
    f"""{ITEMS}, split AS (
      SELECT lottery_id, freq, c, list_filter(items, lambda x: x <> c) AS a FROM (
        SELECT lottery_id, items, freq, unnest(items) AS c FROM sets WHERE len(items) > 1))
    SELECT array_to_string(list_transform(a, lambda x: concat(s.lottery_id, ':', x)), ' ') AS antecedent,
           concat(s.lottery_id, ':', c) AS consequent, round(s.freq / b.freq, 6) AS confidence,
           round(s.freq / b.freq * own.n / o.freq, 6) AS lift
    FROM split s JOIN sets b ON b.lottery_id = s.lottery_id AND b.items = s.a
    JOIN sets o ON o.lottery_id = s.lottery_id AND o.items = [s.c] JOIN own ON own.lottery_id = s.lottery_id
    WHERE s.freq / b.freq >= 0.1""",
)
def _(t):
    sets = checkpoint_frame(extras.frequent_itemsets(t.baskets, SUPPORT))
    return extras.association_rules(t.baskets, sets).select(
        _named("antecedent").alias("antecedent"),
        F.concat_ws(":", "lottery_id", "consequent").alias("consequent"),
        rounded("confidence").alias("confidence"),
        rounded("lift").alias("lift"),
    )


def frame(t):
    return checkpoint_frame(features.feature_frame(t.baskets, t.lottery))


@job("kmeans_draws")
def _(t):
    return extras.kmeans_draws(frame(t))


@job("pca_features")
def _(t):
    return six(extras.pca_features(frame(t)), "pc1", "pc2", "pc3")


@job(
    "mutual_information",
    f"""{BASKET}, seen AS (SELECT DISTINCT lottery_id, number FROM numbers),
    nexts AS (
      SELECT lottery_id, draw_number, lead(draw_number) OVER (PARTITION BY lottery_id ORDER BY draw_number) AS next_draw FROM baskets),
    rows AS (
      SELECT n.lottery_id, s.number, st.consecutive AS x, m.number IS NOT NULL AS y
      FROM nexts n JOIN seen s ON s.lottery_id = n.lottery_id JOIN steps st ON st.draw_number = n.draw_number
      LEFT JOIN members m ON m.draw_number = n.next_draw AND m.number = s.number WHERE next_draw IS NOT NULL),
    cells AS (SELECT lottery_id, number, x, y, count(*)::double AS c FROM rows GROUP BY 1, 2, 3, 4),
    w AS (SELECT *, sum(c) OVER (PARTITION BY lottery_id, number, x) AS cx, sum(c) OVER (PARTITION BY lottery_id, number, y) AS cy,
                 sum(c) OVER (PARTITION BY lottery_id, number) AS n FROM cells)
    SELECT lottery_id, number, round(sum(c / n * log2(c * n / (cx * cy))), 6) AS bits FROM w GROUP BY 1, 2""",
)
def _(t):
    labelled = training.with_next(t.baskets.select("lottery_id", "draw_number", "numbers")).where("next_numbers is not null")
    draws = labelled.select("lottery_id", "next_numbers", features.consecutive_count().alias("consecutive_count"))
    cells = extras.label_cells(draws, training.targets_of(t.baskets), "consecutive_count")
    return six(extras.mutual_information(cells, "consecutive_count", weight="n"), "bits")


@job("lasso_selection")
def _(t):
    nexts = training.next_numbers(t.baskets)
    rows = extras.lasso_rows(features.feature_frame(t.baskets, t.lottery), nexts, training.targets_of(t.baskets))
    return six(extras.lasso_selection(checkpoint_frame(rows)), "weight")
