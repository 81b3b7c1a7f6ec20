"""Catalog: training sets, splits, classifiers and their metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from urnframe.functions.columns import rounded
from urnframe.operators import candidates, features, lookup, metrics, neighbors, training
from urnframe.plans.catalog.features import FEATURES, GRID
from urnframe.plans.registry import job
from urnframe.session import checkpoint_frame

THRESHOLD = 0.085
WIDTH = 5

SCORES = f"""{GRID},
nexts AS (
  SELECT lottery_id, draw_number, lead(draw_number) OVER (PARTITION BY lottery_id ORDER BY draw_number) AS next_draw
  FROM baskets),
scores AS (
  SELECT g.lottery_id, g.draw_number, g.idx, g.number, g.frequency AS seen,
         g.frequency / (g.idx + 1) AS score,
         cast(m.number IS NOT NULL AS int) AS label
  FROM grid g JOIN nexts x ON x.draw_number = g.draw_number AND x.next_draw IS NOT NULL
  LEFT JOIN members m ON m.draw_number = x.next_draw AND m.number = g.number)"""
CUTS = """
cuts AS (
  SELECT lottery_id, draw_number AS cut FROM (
    SELECT lottery_id, draw_number, idx, count(*) OVER (PARTITION BY lottery_id) AS n FROM baskets)
  WHERE idx = (n - 1) * 4 // 5 - 1)"""
PREDICTIONS = f"""{SCORES}, {CUTS},
predictions AS (
  SELECT s.*, cast(score >= {THRESHOLD} AS int) AS prediction
  FROM scores s JOIN cuts c ON c.lottery_id = s.lottery_id WHERE s.draw_number > c.cut)"""


def metric_sql(zero: float, predictions: str = "predictions", name: str = "per_number") -> str:
    return f"""
{name}_counts AS (
  SELECT lottery_id, number, count(*) FILTER (label = 1 AND prediction = 1) AS tp,
         count(*) FILTER (label = 0 AND prediction = 1) AS fp,
         count(*) FILTER (label = 1 AND prediction = 0) AS fn,
         count(*) FILTER (label = 0 AND prediction = 0) AS tn FROM {predictions} GROUP BY 1, 2),
{name} AS (
  SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy,
         CASE WHEN tp + fp = 0 THEN {zero} ELSE tp / (tp + fp) END AS "precision",
         CASE WHEN tp + fn = 0 THEN {zero} ELSE tp / (tp + fn) END AS recall,
         CASE WHEN 2 * tp + fp + fn = 0 THEN {zero} ELSE 2 * tp / (2 * tp + fp + fn) END AS f1
  FROM {name}_counts)"""


NAMES = ["accuracy", "precision", "recall", "f1"]


def predictions(t, held_out=None):
    """Scored and judged rows of the evaluation draws; ``held_out`` may hold them counted already."""
    scored = training.score_counts(training.held_out_draws(t.baskets) if held_out is None else held_out)
    return scored.withColumn("prediction", (F.col("score") >= THRESHOLD).cast("int"))


def six(df, *names):
    return df.select(*[rounded(c).alias(c) if c in names else F.col(c) for c in df.columns])


@job(
    "next_draw_targets",
    f"{SCORES} SELECT lottery_id, draw_number, number, label FROM scores",
)
def _(t):
    return training.next_draw_targets(t.baskets)


@job("frequency_scores", f"{SCORES} SELECT lottery_id, draw_number, number, seen, idx, label FROM scores")
def _(t):
    return training.frequency_scores(t.baskets).drop("score")


@job(
    "walk_forward_split",
    f"""{CUTS} SELECT b.lottery_id, b.draw_number, CASE WHEN b.draw_number <= c.cut THEN 'train' ELSE 'eval' END AS segment
        FROM baskets b JOIN cuts c ON c.lottery_id = b.lottery_id""",
)
def _(t):
    rows = t.baskets.select("lottery_id", "draw_number")
    split = training.walk_forward_split(rows, training.default_cut(t.baskets))
    return training.require_both_sides(split).select("lottery_id", "draw_number", "segment")


@job(
    "check_leakage",
    f"""{CUTS} SELECT b.lottery_id, count(*) AS rows_checked, 0 AS leaking
        FROM baskets b JOIN cuts c ON c.lottery_id = b.lottery_id GROUP BY 1""",
)
def _(t):
    rows = t.baskets.select("lottery_id", "draw_number")
    split = training.walk_forward_split(rows, training.default_cut(t.baskets))
    bad = (F.col("segment") == "eval") & (F.col("draw_number") <= F.col("cut"))
    return training.check_leakage(split).groupBy("lottery_id").agg(
        F.count("*").alias("rows_checked"), F.count_if(bad).alias("leaking")
    )


@job(
    "classification_metrics",
    f"""{PREDICTIONS}, {metric_sql(1.0)} SELECT lottery_id, number, tp, fp, fn, tn,
        {", ".join(f'round("{n}", 6) AS "{n}"' for n in NAMES)} FROM per_number""",
)
def _(t):
    out = metrics.classification_metrics(predictions(t), ["lottery_id", "number"])
    return six(out, *NAMES)


@job(
    "roc_auc",
    f"""{PREDICTIONS}, ranked AS (
      SELECT lottery_id, number, label, rank() OVER w + (count(*) OVER (PARTITION BY lottery_id, number, score) - 1) / 2 AS r
      FROM predictions WINDOW w AS (PARTITION BY lottery_id, number ORDER BY score)),
    sums AS (SELECT lottery_id, number, sum(label) AS p, count(*) - sum(label) AS q,
                    sum(CASE WHEN label = 1 THEN r ELSE 0 END) AS r FROM ranked GROUP BY 1, 2)
    SELECT lottery_id, number,
           round(CASE WHEN p = 0 OR q = 0 THEN 0.5 ELSE (r - p * (p + 1) / 2) / (p * q) END, 6) AS roc_auc FROM sums""",
)
def _(t):
    return six(metrics.roc_auc(predictions(t), ["lottery_id", "number"]), "roc_auc")


@job(
    "trapezoid_auc",
    f"""{PREDICTIONS}, ranked AS (
      SELECT lottery_id, number, label,
             sum(label) OVER (PARTITION BY lottery_id, number ORDER BY score DESC, draw_number) AS ahead FROM predictions),
    sums AS (SELECT lottery_id, number, sum(label) AS p, count(*) - sum(label) AS q,
                    sum(CASE WHEN label = 0 THEN ahead ELSE 0 END) AS a FROM ranked GROUP BY 1, 2)
    SELECT lottery_id, number, round(CASE WHEN p = 0 OR q = 0 THEN 0.5 ELSE a / (p * q) END, 6) AS roc_auc FROM sums""",
)
def _(t):
    return six(metrics.trapezoid_auc(predictions(t), ["lottery_id", "number"]), "roc_auc")


@job(
    "macro_average",
    f"""{PREDICTIONS}, {metric_sql(1.0)},
    means AS (SELECT lottery_id, {", ".join(f'round(avg("{n}"), 8) AS "{n}"' for n in NAMES)} FROM per_number GROUP BY 1)
    SELECT lottery_id, metric_name, value FROM means UNPIVOT (value FOR metric_name IN (accuracy, "precision", recall, f1))""",
)
def _(t):
    wide = metrics.classification_metrics(predictions(t), ["lottery_id", "number"])
    long = metrics.long_metrics(wide, ["lottery_id", "number"], NAMES)
    return metrics.macro_average(long, ["lottery_id"])


@job(
    "multilabel_metrics",
    f"""{SCORES}, {CUTS}, predictions AS (
      SELECT s.*, cast(score >= 0.09 AS int) AS prediction
      FROM scores s JOIN cuts c ON c.lottery_id = s.lottery_id WHERE s.draw_number > c.cut),
    {metric_sql(0.0)},
    means AS (SELECT lottery_id, {", ".join(f'round(avg("{n}"), 8) AS "{n}"' for n in NAMES)} FROM per_number GROUP BY 1)
    SELECT lottery_id, metric_name, value FROM means UNPIVOT (value FOR metric_name IN (accuracy, "precision", recall, f1))""",
)
def _(t):
    return metrics.multilabel_metrics(predictions(t), ["lottery_id"], threshold=0.09)


METRIC_ROWS = f"""{PREDICTIONS}, {metric_sql(1.0)},
metric_rows AS (
  SELECT concat('frequency-', lottery_id) AS model_id, number, metric_name, value
  FROM (SELECT lottery_id, number, accuracy, "precision", recall, f1 FROM per_number)
  UNPIVOT (value FOR metric_name IN (accuracy, "precision", recall, f1)))"""


def metric_rows(t):
    wide = metrics.classification_metrics(predictions(t), ["lottery_id", "number"])
    long = metrics.long_metrics(wide, ["lottery_id", "number"], NAMES)
    return long.select(
        F.concat(F.lit("frequency-"), "lottery_id").alias("model_id"), "number", "metric_name", "value"
    )


@job(
    "read_metrics",
    f"{METRIC_ROWS} SELECT model_id, number, metric_name, round(value, 6) AS value FROM metric_rows WHERE model_id = 'frequency-3'",
)
def _(t):
    return six(lookup.read_metrics(metric_rows(t), "frequency-3"), "value")


@job(
    "top_metrics",
    f"""{METRIC_ROWS} SELECT model_id, number, metric_name, round(value, 6) AS value FROM metric_rows
        ORDER BY metric_rows.value DESC, model_id, metric_name, number LIMIT 20""",
)
def _(t):
    return six(lookup.top_metrics(metric_rows(t), 20), "value")


@job(
    "quantize",
    f"{METRIC_ROWS} SELECT model_id, number, metric_name, round(value, 8) AS value FROM metric_rows",
)
def _(t):
    return metrics.quantized(metric_rows(t))


def frame(t):
    return features.feature_frame(t.baskets, t.lottery)


def ordinals(t):
    return training.with_next(t.baskets.select("lottery_id", "draw_number", "numbers")).select(
        "lottery_id", "draw_number", "idx"
    )


@job(
    "sequence_windows",
    f"""{FEATURES}, w AS (
      SELECT f.lottery_id, f.draw_number, min(f.draw_number) OVER x AS first_draw, count(*) OVER x AS n,
             sum(draw_sum) OVER x AS sums, sum(max_current_gap) OVER x AS gaps, sum(consecutive_count) OVER x AS runs
      FROM feature_frame f
      WINDOW x AS (PARTITION BY lottery_id ORDER BY draw_number ROWS BETWEEN {WIDTH - 1} PRECEDING AND CURRENT ROW))
    SELECT lottery_id, draw_number, first_draw, sums, gaps, runs FROM w WHERE n = {WIDTH}""",
)
def _(t):
    training.require_draws(t.baskets, WIDTH)
    out = training.sequence_windows(frame(t), ordinals(t), WIDTH)

    def total(position: int):
        return F.aggregate("window", F.lit(0.0), lambda acc, row: acc + row[position])

    order = features.FEATURE_ORDER
    return out.select(
        "lottery_id",
        "draw_number",
        "first_draw",
        total(order.index("draw_sum")).alias("sums"),
        total(order.index("max_current_gap")).alias("gaps"),
        total(order.index("consecutive_count")).alias("runs"),
    )


@job(
    "sequence_targets",
    """nexts AS (
      SELECT lottery_id, draw_number, lead(draw_number) OVER (PARTITION BY lottery_id ORDER BY draw_number) AS next_draw
      FROM baskets)
    SELECT n.lottery_id, n.draw_number,
           string_agg(CASE WHEN m.number IS NULL THEN '0' ELSE '1' END, '' ORDER BY u.k) AS y
    FROM nexts n CROSS JOIN range(1, 11) u(k)
    LEFT JOIN members m ON m.draw_number = n.next_draw AND m.number = u.k
    WHERE next_draw IS NOT NULL GROUP BY 1, 2""",
)
def _(t):
    out = training.sequence_targets(t.baskets)
    return out.withColumn("y", F.array_join(F.col("y").cast("array<string>"), ""))


@job(
    "split_windows",
    f"""{CUTS}, w AS (
      SELECT lottery_id, draw_number, lag(draw_number, {WIDTH - 1}) OVER (PARTITION BY lottery_id ORDER BY draw_number) AS first_draw
      FROM baskets)
    SELECT w.lottery_id, w.draw_number, w.first_draw,
           CASE WHEN w.draw_number <= c.cut THEN 'train' ELSE 'eval' END AS segment
    FROM w JOIN cuts c ON c.lottery_id = w.lottery_id
    WHERE w.first_draw IS NOT NULL AND (w.draw_number <= c.cut OR w.first_draw > c.cut)""",
)
def _(t):
    windows = training.sequence_windows(frame(t), ordinals(t), WIDTH)
    out = training.split_windows(windows, training.default_cut(t.baskets))
    return out.select("lottery_id", "draw_number", "first_draw", "segment")


K = 5


def knn_sql(k: int) -> str:
    return f"""{FEATURES}, {CUTS},
vectors AS (
  SELECT f.*, f.draw_number <= c.cut AS is_train
  FROM feature_frame f JOIN cuts c ON c.lottery_id = f.lottery_id),
knn AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY draw_number ORDER BY d2, neighbor) AS rank FROM (
      SELECT e.lottery_id, e.draw_number, v.draw_number AS neighbor,
             round({" + ".join(f"(e.{c} - v.{c}) * (e.{c} - v.{c})" for c in features.FEATURE_ORDER)}, 9) AS d2
      FROM vectors e JOIN vectors v ON v.lottery_id = e.lottery_id AND v.is_train AND NOT e.is_train))
  WHERE rank <= {k})"""


KNN = knn_sql(K)


def knn(t, k: int = K):
    vectors = checkpoint_frame(
        training.walk_forward_split(frame(t), training.default_cut(t.baskets))
    )
    doubles = vectors.select(
        "lottery_id", "draw_number", "segment", *[F.col(c).cast("double").alias(c) for c in features.FEATURE_ORDER]
    )
    return neighbors.nearest(
        doubles.where("segment = 'train'").drop("segment"),
        doubles.where("segment = 'eval'").drop("segment"),
        k,
    )


@job(
    "nearest_draws",
    f"{KNN} SELECT lottery_id, draw_number, rank, neighbor, round(d2, 6) AS d2 FROM knn",
)
def _(t):
    return six(knn(t), "d2")


@job(
    "knn_classify",
    f"""{KNN}, nexts AS (
      SELECT draw_number, lead(draw_number) OVER (PARTITION BY lottery_id ORDER BY draw_number) AS next_draw FROM baskets)
    SELECT k.lottery_id, k.draw_number, m.number, count(*) / 5 AS score,
           cast(count(*) / 5 >= 0.5 AS int) AS prediction
    FROM knn k JOIN nexts n ON n.draw_number = k.neighbor JOIN members m ON m.draw_number = n.next_draw
    GROUP BY 1, 2, 3""",
)
def _(t):
    return neighbors.knn_votes(knn(t), training.next_draw_targets(t.baskets))


KS = [1, 2, 3, 5, 8]


@job(
    "evaluate_knn",
    f"""{knn_sql(max(KS))}, nexts AS (
      SELECT lottery_id, draw_number, lead(draw_number) OVER (PARTITION BY lottery_id ORDER BY draw_number) AS next_draw FROM baskets),
    k AS (SELECT row_number() OVER () AS eval_num, k FROM (SELECT unnest({KS}) AS k)),
    votes AS (
      SELECT n.lottery_id, n.draw_number, m.number, k.eval_num, count(*) >= k.k / 2 AS said
      FROM knn n JOIN k ON n.rank <= k.k JOIN nexts x ON x.draw_number = n.neighbor JOIN members m ON m.draw_number = x.next_draw
      GROUP BY n.lottery_id, n.draw_number, m.number, k.eval_num, k.k),
    asked AS (
      SELECT DISTINCT n.lottery_id, n.draw_number, x.next_draw FROM knn n JOIN nexts x ON x.draw_number = n.draw_number
      WHERE x.next_draw IS NOT NULL),
    was AS (SELECT a.lottery_id, a.draw_number, m.number FROM asked a JOIN members m ON m.draw_number = a.next_draw),
    per AS (
      SELECT u.lottery_id, u.number, k.eval_num,
             (SELECT count(*) FROM votes v JOIN asked a ON a.draw_number = v.draw_number
              WHERE v.said AND v.lottery_id = u.lottery_id AND v.number = u.number AND v.eval_num = k.eval_num) AS said,
             (SELECT count(*) FROM votes v JOIN was w ON w.draw_number = v.draw_number AND w.number = v.number
              WHERE v.said AND v.lottery_id = u.lottery_id AND v.number = u.number AND v.eval_num = k.eval_num) AS hit,
             (SELECT count(*) FROM was w WHERE w.lottery_id = u.lottery_id AND w.number = u.number) AS yes
      FROM (SELECT DISTINCT lottery_id, number FROM numbers) u CROSS JOIN k)
    SELECT lottery_id, eval_num, round(avg(CASE WHEN said + yes = 0 THEN 0 ELSE 2 * hit / (said + yes) END), 8) AS fitness
    FROM per GROUP BY 1, 2""",
)
def _(t):
    grid = F.posexplode(F.array(*map(F.lit, KS))).alias("_at", "k")
    space = t.lottery.select("lottery_id", grid).select("lottery_id", (F.col("_at") + 1).cast("long").alias("eval_num"), "k")
    found = checkpoint_frame(knn(t, max(KS)))
    return candidates.evaluate_knn(found, training.next_numbers(t.baskets), space, training.targets_of(t.baskets))


@job("evaluate_forest")
def _(t):
    """Depth and number of trees of a random forest, over every (lottery, number)."""
    shapes = F.posexplode(F.array(*[F.struct(F.lit(d).alias("depth"), F.lit(n).alias("trees")) for d, n in ((1, 5), (3, 5))]))
    space = t.lottery.select("lottery_id", shapes.alias("_at", "s")).select(
        "lottery_id", (F.col("_at") + 1).cast("long").alias("eval_num"), "s.depth", "s.trees"
    )
    rows = training.training_rows(frame(t), training.next_numbers(t.baskets), training.default_cut(t.baskets))
    return candidates.evaluate_models(rows, training.targets_of(t.baskets), space, "random_forest", "accuracy")


def model_metrics(scored):
    by = ["lottery_id", "number"]
    return metrics.classification_metrics(scored, by).join(metrics.roc_auc(scored, by), by)


def _family_job(family: str) -> None:
    @job(f"train_{family}")
    def _(t):
        cuts = training.default_cut(t.baskets)
        rows = training.training_rows(frame(t), training.next_numbers(t.baskets), cuts)
        return model_metrics(training.train_family(family, rows, training.targets_of(t.baskets)))


for _family in training.FAMILIES:
    _family_job(_family)


@job("train_mlp")
def _(t):
    windows = training.sequence_windows(frame(t), ordinals(t), WIDTH)
    cuts = training.default_cut(t.baskets)
    rows = training.sequence_rows(windows, training.next_numbers(t.baskets), cuts)
    return model_metrics(training.train_family("mlp", rows, training.sequence_models(t.baskets)))
