"""Catalog: parameter search, experiments, ranking, allocation and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from urnframe.functions.columns import rounded
from urnframe.operators import (
    backtest,
    experiments,
    lookup,
    metrics,
    probability,
    ranking,
    sampling,
    search,
    training,
)
from urnframe.plans.catalog import backtesting
from urnframe.plans.catalog.backtesting import BENCH
from urnframe.plans.catalog.probability import EMPIRICAL
from urnframe.plans.catalog.statistics import FREQ
from urnframe.plans.catalog.training import CUTS, NAMES, PREDICTIONS, SCORES, metric_sql, predictions
from urnframe.plans.registry import job
from urnframe.session import checkpoint_frame

SPACE = {
    "threshold": {"type": "continuous", "low": 0.06, "high": 0.12},
    "alpha": {"type": "discrete", "choices": [0.0, 5.0, 20.0]},
    "min_seen": {"type": "integer", "low": 0, "high": 8},
}
BUDGET, SEED, PATIENCE = 24, 5, 6


def _u(name: str) -> str:
    digest = f"md5(concat_ws('|', {SEED}, lottery_id, eval_num, '{name}'))"
    return f"cast('0x' || substr({digest}, 1, 8) AS bigint)"


CANDIDATES = f"""
candidates AS (
  SELECT lottery_id, eval_num, 0.06::double + {_u("threshold")} / 4294967296.0::double * (0.12::double - 0.06::double) AS threshold,
         CASE {_u("alpha")} % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 5.0 ELSE 20.0 END::double AS alpha,
         {_u("min_seen")} % 8 AS min_seen
  FROM lottery, range(1, {BUDGET + 1}) r(eval_num))"""
SEARCH = f"""
search_rows AS (
  SELECT s.lottery_id, c.eval_num, s.label,
         round((s.seen + c.alpha * (4 / 45)) / (s.idx + 1 + c.alpha), 8) >= c.threshold AND s.seen >= c.min_seen AS said
  FROM scores s JOIN cuts t ON t.lottery_id = s.lottery_id AND s.draw_number > t.cut
  JOIN candidates c ON c.lottery_id = s.lottery_id),
search AS (
  SELECT lottery_id, eval_num, CASE WHEN b = 0 THEN 0.0 ELSE 2 * tp / b END AS fitness FROM (
    SELECT lottery_id, eval_num, count(*) FILTER (said AND label = 1) AS tp,
           2 * count(*) FILTER (said AND label = 1) + count(*) FILTER (said AND label = 0)
             + count(*) FILTER (NOT said AND label = 1) AS b
    FROM search_rows GROUP BY 1, 2))"""
SEARCHED = f"{SCORES}, {CUTS}, {CANDIDATES}, {SEARCH}"
HISTORY = """
history AS (
  SELECT *, max(fitness) OVER (PARTITION BY lottery_id ORDER BY eval_num) AS best_fitness FROM search)"""


def candidates(t):
    return search.sample_candidates(t.lottery.select("lottery_id"), SPACE, BUDGET, SEED)


def searched(t, held_out=None):
    draws = training.held_out_draws(t.baskets) if held_out is None else held_out
    # A state is a row: candidates are judged where it lies and only their counts are shuffled.
    states = training.score_counts(draws).select(
        "lottery_id", "seen", (F.col("idx") + 1).alias("draws"), "label", F.lit(1).cast("long").alias("n")
    )
    prior = F.col("numbers_to_select") / (F.col("max_number") - F.col("min_number") + 1)
    ruled = states.join(t.lottery.select("lottery_id", prior.alias("prior")), "lottery_id")
    return search.evaluate_candidates(ruled, candidates(t))


def six(df, *names):
    return df.select(*[rounded(c).alias(c) if c in names else F.col(c) for c in df.columns])


@job(
    "sample_candidates",
    f"{CANDIDATES} SELECT lottery_id, eval_num, round(threshold, 6) AS threshold, alpha, min_seen FROM candidates",
)
def _(t):
    return six(candidates(t), "threshold")


@job(
    "evaluate_candidates",
    f"{SEARCHED} SELECT lottery_id, eval_num, round(fitness, 6) AS fitness FROM search",
)
def _(t):
    return six(searched(t), "fitness")


@job(
    "convergence_history",
    f"""{SEARCHED}, {HISTORY} SELECT lottery_id, eval_num, round(fitness, 6) AS fitness,
          round(best_fitness, 6) AS best_fitness FROM history""",
)
def _(t):
    return six(search.convergence_history(searched(t)), "fitness", "best_fitness")


@job(
    "early_stop_at",
    f"""{SEARCHED}, {HISTORY}, lagged AS (
      SELECT *, lag(best_fitness, {PATIENCE - 1}) OVER (PARTITION BY lottery_id ORDER BY eval_num) AS before FROM history)
    SELECT lottery_id, min(CASE WHEN eval_num > {PATIENCE} AND best_fitness = before THEN eval_num END) AS stop_at,
           count(*) AS evaluations FROM lagged GROUP BY 1""",
)
def _(t):
    return search.early_stop_at(search.convergence_history(searched(t)), PATIENCE)


@job(
    "best_candidate",
    f"""{SEARCHED} SELECT lottery_id, eval_num, round(fitness, 6) AS fitness FROM (
      SELECT *, row_number() OVER (PARTITION BY lottery_id ORDER BY fitness DESC, eval_num) AS r FROM search)
    WHERE r = 1""",
)
def _(t):
    return six(search.best_candidate(searched(t)), "fitness")


@job(
    "read_search_results",
    f"""{SEARCHED} SELECT lottery_id AS snapshot_id, 'frequency' AS target_model, eval_num, round(fitness, 6) AS fitness
        FROM search WHERE lottery_id = 4""",
)
def _(t):
    stored = searched(t).select(
        F.col("lottery_id").alias("snapshot_id"),
        F.lit("frequency").alias("target_model"),
        "eval_num",
        "fitness",
    )
    return six(lookup.read_search_results(stored, 4, "frequency"), "fitness")


# --- runs of four engines --------------------------------------------------

ENGINES = f"""{BENCH}, {PREDICTIONS}, {metric_sql(1.0)},
predictions_dl AS (
  SELECT lottery_id, number, label, cast(score >= 0.09 AS int) AS prediction FROM predictions),
{metric_sql(0.0, "predictions_dl", "per_label")}, {CANDIDATES}, {SEARCH},
engine_rows AS (
  SELECT lottery_id, 'backtesting' AS engine_type, lottery_id * 10 + 1 AS snapshot_id, predictor AS model_id,
         1 AS seq, metric_name, value
  FROM (SELECT lottery_id, predictor, hit_rate, average_matches, consistency_score FROM per_predictor)
  UNPIVOT (value FOR metric_name IN (hit_rate, average_matches, consistency_score))
  UNION ALL
  SELECT lottery_id, 'ml', lottery_id * 10 + 2, 'frequency', number, metric_name, value
  FROM (SELECT lottery_id, number, accuracy, "precision", recall, f1 FROM per_number)
  UNPIVOT (value FOR metric_name IN (accuracy, "precision", recall, f1))
  UNION ALL
  SELECT lottery_id, 'dl', lottery_id * 10 + 3, 'sequence', number, metric_name, value
  FROM (SELECT lottery_id, number, accuracy, "precision", recall, f1 FROM per_label)
  UNPIVOT (value FOR metric_name IN (accuracy, "precision", recall, f1))
  UNION ALL
  SELECT lottery_id, 'optimization', lottery_id * 10 + 4, 'random', 1, 'best_fitness', max(fitness)
  FROM search GROUP BY 1),
merged AS (
  SELECT lottery_id, engine_type, snapshot_id, model_id, metric_name, avg(value) AS value
  FROM engine_rows GROUP BY 1, 2, 3, 4, 5)"""


def engine_rows(t):
    bt = backtest.aggregate_windows(backtest.window_metrics(backtesting.matched(t)))
    bt = metrics.long_metrics(bt, ["lottery_id", "predictor"], backtest.METRICS).select(
        "lottery_id",
        (F.col("lottery_id") * 10 + 1).alias("snapshot_id"),
        F.col("predictor").alias("model_id"),
        F.lit(1).alias("seq"),
        "metric_name",
        rounded("value").alias("value"),
    )
    counted = checkpoint_frame(training.held_out_draws(t.baskets))
    held_out = predictions(t, counted)

    def labelled(rows, zero: float, code: int, model: str):
        wide = metrics.classification_metrics(rows, ["lottery_id", "number"], zero)
        return metrics.long_metrics(wide, ["lottery_id", "number"], NAMES).select(
            "lottery_id",
            (F.col("lottery_id") * 10 + code).alias("snapshot_id"),
            F.lit(model).alias("model_id"),
            F.col("number").alias("seq"),
            "metric_name",
            "value",
        )

    strict = held_out.withColumn("prediction", (F.col("score") >= 0.09).cast("int"))
    opt = search.best_candidate(searched(t, counted)).select(
        "lottery_id",
        (F.col("lottery_id") * 10 + 4).alias("snapshot_id"),
        F.lit("random").alias("model_id"),
        F.lit(1).alias("seq"),
        F.lit("best_fitness").alias("metric_name"),
        F.col("fitness").alias("value"),
    )
    return experiments.engine_metrics(
        backtesting=bt,
        ml=labelled(held_out, 1.0, 2, "frequency"),
        dl=labelled(strict, 0.0, 3, "sequence"),
        optimization=opt,
    )


def merged(t):
    # Written once: rankings and comparisons pass over these few rows several times.
    return checkpoint_frame(experiments.merge_duplicate_metrics(engine_rows(t)))


@job(
    "engine_metrics",
    f"""{ENGINES} SELECT lottery_id, engine_type, snapshot_id, model_id, seq, metric_name, round(value, 6) AS value
        FROM engine_rows""",
)
def _(t):
    return six(engine_rows(t), "value")


@job(
    "merge_duplicate_metrics",
    f"""{ENGINES} SELECT lottery_id, engine_type, snapshot_id, model_id, metric_name, round(value, 6) AS value FROM merged""",
)
def _(t):
    return six(merged(t), "value")


@job(
    "fold_duplicate_metrics",
    f"""{ENGINES}, folded AS (
      SELECT lottery_id, engine_type, snapshot_id, model_id, metric_name,
             list_reduce(list(value::double ORDER BY seq), lambda a, b: (a + b) / 2) AS value
      FROM engine_rows GROUP BY 1, 2, 3, 4, 5)
    SELECT lottery_id, engine_type, snapshot_id, model_id, metric_name, round(value, 6) AS value FROM folded""",
)
def _(t):
    return six(experiments.merge_duplicate_metrics(engine_rows(t), fold=True), "value")


@job(
    "compare_runs",
    f"""{ENGINES} SELECT concat_ws('-', engine_type, snapshot_id, model_id) AS run_label,
          {", ".join(f'''round(max(CASE WHEN metric_name = '{n}' THEN value END), 6) AS "{n}"''' for n in sorted(NAMES))}
        FROM merged WHERE engine_type IN ('ml', 'dl') GROUP BY 1""",
)
def _(t):
    rows = merged(t)
    wanted = rows.where(F.col("engine_type").isin("ml", "dl")).select("engine_type", "snapshot_id").distinct()
    experiments.require_runs(rows, wanted)
    return six(experiments.compare_runs(rows, wanted, NAMES), *NAMES)


@job(
    "best_run_per_metric",
    f"""{ENGINES}, r AS (
      SELECT metric_name, concat_ws('-', engine_type, snapshot_id, model_id) AS run_label, value,
             row_number() OVER w AS r, lead(value) OVER w AS second FROM merged
      WINDOW w AS (PARTITION BY metric_name ORDER BY value DESC, concat_ws('-', engine_type, snapshot_id, model_id)))
    SELECT metric_name, run_label AS best_run, round(value, 6) AS best_value,
           round(value - coalesce(second, 0), 6) AS delta FROM r WHERE r = 1""",
)
def _(t):
    return experiments.best_run_per_metric(merged(t))


COMPARISONS = """
comparisons AS (
  SELECT b.lottery_id AS experiment_id, b.draw_number AS comparison_id,
         string_agg(cast(m.number AS varchar), ',' ORDER BY m.number) AS ids,
         CASE WHEN b.jackpot IS NULL THEN NULL ELSE string_agg(cast(m.number AS varchar), ',' ORDER BY m.number) END AS run_ids,
         b.winners IS NULL AS broken
  FROM baskets b JOIN members m ON m.draw_number = b.draw_number GROUP BY b.lottery_id, b.draw_number, b.jackpot, b.winners)"""


def comparisons(t):
    """A comparison per draw: its numbers are the run ids, kept in JSON that is cut at times."""
    runs = F.transform("numbers", lambda n: F.struct(n.cast("long").alias("run_id")))
    payload = F.to_json(F.struct(runs.alias("runs")))
    cut = F.when(F.col("winners").isNull(), F.expr("substring(_json, 1, 9)")).otherwise(F.col("_json"))
    ids = F.array_join(F.sort_array("numbers").cast("array<string>"), ",")
    return t.baskets.withColumn("_json", payload).select(
        F.col("lottery_id").alias("experiment_id"),
        F.col("draw_number").alias("comparison_id"),
        F.when(F.col("jackpot").isNotNull(), ids).alias("run_ids"),
        cut.alias("comparison_json"),
    )


@job(
    "run_ids_key",
    f"{COMPARISONS} SELECT experiment_id, comparison_id, CASE WHEN NOT broken THEN ids END AS run_ids_key FROM comparisons",
)
def _(t):
    keyed = experiments.run_ids_key(comparisons(t))
    return keyed.select("experiment_id", "comparison_id", "run_ids_key")


@job(
    "find_comparison",
    f"""{COMPARISONS}, keyed AS (
      SELECT experiment_id, comparison_id, coalesce(run_ids, CASE WHEN NOT broken THEN ids END) AS key FROM comparisons),
    wanted AS (SELECT DISTINCT experiment_id, ids AS key FROM comparisons WHERE broken)
    SELECT w.experiment_id, w.key, min(k.comparison_id) AS comparison_id
    FROM wanted w JOIN keyed k ON k.experiment_id = w.experiment_id AND k.key = w.key GROUP BY 1, 2""",
)
def _(t):
    wanted = t.baskets.where("winners is null").select(
        F.col("lottery_id").alias("experiment_id"),
        F.array_join(F.sort_array("numbers").cast("array<string>"), ",").alias("key"),
    )
    return experiments.find_comparison(wanted.distinct(), comparisons(t))


EXPERIMENTS = """
experiments AS (
  SELECT lottery_id, draw_number AS experiment_id, concat('plan-', super_number, '-', coalesce(winners, 0)) AS name,
         CASE WHEN is_deleted THEN 'retired' ELSE 'active' END AS status, draw_date AS created_at FROM draws)"""


def experiment_rows(t):
    return t.draws.select(
        "lottery_id",
        F.col("draw_number").alias("experiment_id"),
        F.concat(
            F.lit("plan-"), "super_number", F.lit("-"), F.coalesce("winners", F.lit(0))
        ).alias("name"),
        F.when(F.col("is_deleted"), "retired").otherwise("active").alias("status"),
        F.col("draw_date").alias("created_at"),
    )


@job(
    "list_experiments",
    f"{EXPERIMENTS} SELECT experiment_id, name, created_at FROM experiments WHERE lottery_id = 3 AND status = 'active'",
)
def _(t):
    out = experiments.list_experiments(experiment_rows(t), 3, "active")
    return out.select("experiment_id", "name", "created_at")


@job(
    "resolve_runs",
    """SELECT l_orderkey AS run_id, l_linenumber AS run_no,
              CASE WHEN l_linenumber % 2 = 0 THEN 'ml' ELSE 'backtesting' END AS engine_type,
              CASE WHEN l_linenumber % 2 = 0 THEN s_name ELSE p_name END AS identity
       FROM lineitem LEFT JOIN supplier ON l_linenumber % 2 = 0 AND s_suppkey = l_suppkey
       LEFT JOIN part ON l_linenumber % 2 = 1 AND p_partkey = l_partkey""",
)
def _(t):
    even = F.col("l_linenumber") % 2 == 0
    runs = t.raw("lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").alias("run_no"),
        F.when(even, "ml").otherwise("backtesting").alias("engine_type"),
        F.when(even, F.col("l_suppkey")).otherwise(F.col("l_partkey")).alias("engine_snapshot_id"),
    )
    ml = t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("fingerprint"))
    bt = t.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("checksum"))
    out = experiments.resolve_runs(runs, ml=ml, backtesting=bt)
    return out.select("run_id", "run_no", "engine_type", "identity")


@job(
    "duplicate_names",
    f"""{EXPERIMENTS} SELECT lottery_id, name, count(*) AS n FROM experiments WHERE status = 'active'
        GROUP BY 1, 2 HAVING count(*) > 1""",
)
def _(t):
    return experiments.duplicate_names(experiment_rows(t))


@job(
    "experiment_versions",
    """log AS (
      SELECT o_custkey AS experiment_id, o_orderkey AS seq, o_orderstatus AS fingerprint,
             o_orderpriority = '5-LOW' AND o_orderstatus = 'F' AS retired FROM orders),
    live AS (
      SELECT l.* FROM log l LEFT JOIN (SELECT experiment_id, min(seq) AS e FROM log WHERE retired GROUP BY 1) x
        ON x.experiment_id = l.experiment_id WHERE x.e IS NULL OR l.seq <= x.e),
    flagged AS (
      SELECT *, lag(fingerprint) OVER (PARTITION BY experiment_id ORDER BY seq) IS DISTINCT FROM fingerprint AS c FROM live)
    SELECT experiment_id, seq, sum(cast(c AS int)) OVER (PARTITION BY experiment_id ORDER BY seq) AS version FROM flagged""",
)
def _(t):
    retired = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "F")
    log = t.raw("orders").select(
        F.col("o_custkey").alias("experiment_id"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderstatus").alias("fingerprint"),
        F.when(retired, "retired").otherwise("active").alias("status"),
    )
    return experiments.experiment_versions(log)


# --- ranking ---------------------------------------------------------------

HEADERS = """
headers AS (
  SELECT lottery_id, engine_type, lottery_id * 10 + code AS snapshot_id,
         CASE WHEN lottery_id = 5 AND code = 3 THEN 'retired' ELSE 'active' END AS status,
         draws_from, draws_to, draws_to - 100 AS cut, 5 AS "window", draw_count AS created_at
  FROM (SELECT lottery_id, count(*) AS draw_count, min(draw_number) AS draws_from, max(draw_number) AS draws_to
        FROM baskets GROUP BY 1),
       (VALUES (1, 'backtesting'), (2, 'ml'), (3, 'dl'), (4, 'optimization')) e(code, engine_type))"""
MODELS = f"""{ENGINES}, {HEADERS},
models AS (
  SELECT lottery_id, engine_type, concat_ws('-', CASE engine_type WHEN 'backtesting' THEN 'bt' WHEN 'optimization' THEN 'opt'
           ELSE engine_type END, model_id, snapshot_id) AS model_id,
         CASE metric_name WHEN 'f1' THEN 'f1_score' ELSE metric_name END AS metric_name, value
  FROM merged m WHERE (engine_type, snapshot_id) IN (SELECT engine_type, snapshot_id FROM headers WHERE status = 'active')
    AND metric_name IN ('hit_rate', 'average_matches', 'consistency_score', 'precision', 'recall', 'f1'))"""
NORMAL = """
scaled AS (
  SELECT lottery_id, engine_type, model_id, metric_name,
         CASE WHEN n = 1 THEN 1.0 WHEN hi = lo THEN 0.0
              WHEN metric_name = 'consistency_score' THEN (hi - value) / (hi - lo) ELSE (value - lo) / (hi - lo) END AS value
  FROM (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi, count(value) OVER w AS n FROM models
        WINDOW w AS (PARTITION BY lottery_id, engine_type, metric_name))),
wide AS (
  SELECT lottery_id, engine_type, model_id, """ + ", ".join(
    f"coalesce(max(CASE WHEN metric_name = '{n}' THEN value END), 0.0) AS \"{n}\"" for n in ranking.COMMON_METRICS
) + """
  FROM scaled GROUP BY 1, 2, 3),
scored AS (
  SELECT *, round(0.3 * hit_rate + 0.3 * average_matches + 0.2 * consistency_score + 0.1 * "precision" + 0.1 * recall, 8) AS score
  FROM wide),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lottery_id ORDER BY score DESC,
    cast('0x' || substr(md5(model_id), 1, 8) AS bigint)) AS rank FROM scored)"""
RANKED = f"{MODELS}, {NORMAL}"


def headers(t):
    ranges = t.baskets.groupBy("lottery_id").agg(
        F.count("*").alias("draw_count"),
        F.min("draw_number").alias("draws_from"),
        F.max("draw_number").alias("draws_to"),
    )
    codes = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("code"), F.lit(e).alias("engine_type"))
                for i, e in enumerate(("backtesting", "ml", "dl", "optimization"), 1)
            ]
        )
    )
    retired = (F.col("lottery_id") == 5) & (F.col("e.code") == 3)
    return ranges.withColumn("e", codes).select(
        "lottery_id",
        "e.engine_type",
        (F.col("lottery_id") * 10 + F.col("e.code")).cast("long").alias("snapshot_id"),
        F.when(retired, "retired").otherwise("active").alias("status"),
        "draws_from",
        "draws_to",
        (F.col("draws_to") - 100).alias("cut"),
        F.lit(5).alias("window"),
        F.col("draw_count").alias("created_at"),
    )


def models(t):
    return ranking.model_metrics(merged(t), headers(t))


def scored(t):
    from urnframe.functions.columns import hash_int

    wide = ranking.normalize_metrics(models(t))
    return ranking.composite_score(wide).withColumn("input_order", hash_int(F.col("model_id")))


def ranked(t):
    return ranking.rank_models(checkpoint_frame(scored(t)))


@job(
    "model_metrics",
    f"{MODELS} SELECT lottery_id, engine_type, model_id, metric_name, round(value, 6) AS value FROM models",
)
def _(t):
    return six(models(t), "value")


@job(
    "context_vector",
    f"""{HEADERS} SELECT lottery_id, engine_type,
          CASE WHEN engine_type IN ('ml', 'dl') THEN draws_from ELSE 0 END AS draws_from,
          CASE WHEN engine_type IN ('ml', 'dl') THEN draws_to ELSE 0 END AS draws_to,
          CASE WHEN engine_type IN ('ml', 'dl') THEN cut END AS cut,
          CASE WHEN engine_type = 'dl' THEN "window" END AS "window"
        FROM headers WHERE status = 'active'""",
)
def _(t):
    return ranking.context_vector(headers(t))


@job(
    "normalize_metrics",
    f"""{RANKED} SELECT lottery_id, engine_type, model_id,
          {", ".join(f'round("{n}", 6) AS "{n}"' for n in ranking.COMMON_METRICS)} FROM wide""",
)
def _(t):
    return six(ranking.normalize_metrics(models(t)), *ranking.COMMON_METRICS)


@job(
    "composite_score",
    f"{RANKED} SELECT lottery_id, engine_type, model_id, round(score, 6) AS score FROM scored",
)
def _(t):
    return six(scored(t).select("lottery_id", "engine_type", "model_id", "score"), "score")


@job(
    "rank_models",
    f"{RANKED} SELECT lottery_id, model_id, round(score, 6) AS score, rank FROM ranked",
)
def _(t):
    return six(ranked(t).select("lottery_id", "model_id", "score", "rank"), "score")


SELECTED = """
selected AS (
  SELECT lottery_id, model_id, score, row_number() OVER (PARTITION BY lottery_id ORDER BY rank) AS rank
  FROM ranked WHERE score >= 0.05),
entries AS (SELECT * FROM selected WHERE rank <= 3)"""


def entries(t):
    chosen = ranking.select_top_k(ranked(t), 3, 0.05)
    return chosen.select("lottery_id", "model_id", "score", "rank")


@job(
    "select_top_k",
    f"{RANKED}, {SELECTED} SELECT lottery_id, model_id, round(score, 6) AS score, rank FROM entries",
)
def _(t):
    return six(entries(t), "score")


VERSIONS = """
versions AS (
  SELECT lottery_id, draw_number AS version, concat('context-', winners) AS context FROM baskets WHERE winners IS NOT NULL)"""


def versions(t):
    return t.baskets.where("winners is not null").select(
        "lottery_id",
        F.col("draw_number").alias("version"),
        F.concat(F.lit("context-"), "winners").alias("context"),
    )


@job("list_rankings", f"{VERSIONS} SELECT * FROM versions WHERE lottery_id = 1 AND context = 'context-4'")
def _(t):
    return ranking.list_versions(versions(t), 1, "context-4")


@job("list_selections", f"{VERSIONS} SELECT * FROM versions WHERE lottery_id = 2 AND context = 'context-7'")
def _(t):
    return ranking.list_versions(versions(t), 2, "context-7")


# --- allocation and sampling -----------------------------------------------

COUNT, SAMPLE_SEED, TRIES = 100, 3, 4
ALLOCATED = f"""
micro AS (SELECT *, cast(round(score * 1000000) AS bigint) AS m FROM entries),
based AS (
  SELECT *, m * {COUNT} // sum(m) OVER (PARTITION BY lottery_id) AS base FROM micro),
allocation AS (
  SELECT lottery_id, model_id, score, rank, cast(base + CASE WHEN
      row_number() OVER (PARTITION BY lottery_id ORDER BY m DESC, rank)
        <= {COUNT} - sum(base) OVER (PARTITION BY lottery_id) THEN 1 ELSE 0 END AS bigint) AS allocated
  FROM based)"""


def allocation(t):
    return sampling.allocate_count(entries(t), COUNT)


@job(
    "allocate_count",
    f"{RANKED}, {SELECTED}, {ALLOCATED} SELECT lottery_id, model_id, rank, allocated FROM allocation",
)
def _(t):
    return allocation(t).select("lottery_id", "model_id", "rank", "allocated")


def distribution(t):
    values = probability.prob_values(t.baskets, t.lottery, ["empirical"])
    return probability.number_distribution(values)


# The allocated entries of the sampling jobs come from frequencies alone.
SHARES = f"""{EMPIRICAL},
shares AS (
  SELECT lottery_id, 1 AS rank, 0.5 AS score, 60 AS allocated FROM lottery
  UNION ALL SELECT lottery_id, 2, 0.3, 40 FROM lottery),
pool AS (
  SELECT s.lottery_id, s.rank, s.allocated, e.number, round(e.value, 8) * s.score AS weight
  FROM shares s JOIN empirical e ON e.lottery_id = s.lottery_id)"""


def shares(t):
    parts = F.explode(
        F.array(
            F.struct(F.lit(1).alias("rank"), F.lit(0.5).alias("score"), F.lit(60).cast("long").alias("allocated")),
            F.struct(F.lit(2).alias("rank"), F.lit(0.3).alias("score"), F.lit(40).cast("long").alias("allocated")),
        )
    )
    return t.lottery.select("lottery_id", parts.alias("s")).select("lottery_id", "s.*")


@job(
    "weighted_pool",
    f"{SHARES} SELECT lottery_id, rank, number, round(weight, 6) AS weight FROM pool",
)
def _(t):
    out = sampling.weighted_pool(shares(t), distribution(t))
    return six(out.select("lottery_id", "rank", "number", "weight"), "weight")


def _sample_sql() -> str:
    served = """
kept1 AS (
  SELECT *, row_number() OVER (PARTITION BY lottery_id ORDER BY attempt) AS position FROM sets WHERE rank = 1),
served1 AS (SELECT * FROM kept1 WHERE position <= 60),
kept2 AS (
  SELECT *, row_number() OVER (PARTITION BY lottery_id ORDER BY attempt) AS position FROM sets s WHERE rank = 2
    AND NOT EXISTS (SELECT 1 FROM served1 k WHERE k.lottery_id = s.lottery_id AND k.numbers = s.numbers))"""
    return f"""{SHARES}, bounds AS (
  SELECT lottery_id, rank, number,
         sum(weight) OVER (PARTITION BY lottery_id, rank ORDER BY number)
           / sum(weight) OVER (PARTITION BY lottery_id, rank) AS upper FROM pool),
rolls AS (
  SELECT s.lottery_id, s.rank, a.attempt, i.i,
         cast('0x' || substr(md5(concat_ws('|', {SAMPLE_SEED}, s.lottery_id, s.rank, a.attempt, i.i)), 1, 8) AS bigint)
           / 4294967296.0::double AS u
  FROM shares s, range(1, {60 * TRIES + 1}) a(attempt), range(1, 5) i(i) WHERE a.attempt <= s.allocated * {TRIES}),
picked AS (
  SELECT r.lottery_id, r.rank, r.attempt, r.i, min(b.number) AS number
  FROM rolls r JOIN bounds b ON b.lottery_id = r.lottery_id AND b.rank = r.rank AND b.upper > r.u GROUP BY 1, 2, 3, 4),
tried AS (
  SELECT lottery_id, rank, attempt, string_agg(cast(number AS varchar), ',' ORDER BY number) AS numbers
  FROM picked GROUP BY 1, 2, 3 HAVING count(DISTINCT number) = 4),
sets AS (SELECT lottery_id, rank, numbers, min(attempt) AS attempt FROM tried GROUP BY 1, 2, 3), {served}
SELECT lottery_id, rank, position, numbers FROM served1
UNION ALL SELECT lottery_id, rank, position, numbers FROM kept2 WHERE position <= 40"""


@job("sample_combinations", _sample_sql())
def _(t):
    pool = sampling.weighted_pool(shares(t), distribution(t))
    out = sampling.sample_combinations(shares(t), pool, t.lottery, SAMPLE_SEED, TRIES)
    return sampling.combinations_of(out).withColumn(
        "numbers", F.array_join(F.col("numbers").cast("array<string>"), ",")
    )


@job(
    "validate_combination",
    """m AS (SELECT draw_number, count(*) AS c FROM numbers GROUP BY 1)
    SELECT b.lottery_id, b.draw_number, m.c = 4 AND b.super_number BETWEEN 1 AND 16 AS valid
    FROM baskets b JOIN m ON m.draw_number = b.draw_number""",
)
def _(t):
    ruled = t.baskets.join(t.lottery, "lottery_id")
    ok = sampling.validate_combination(
        F.sort_array("numbers"),
        F.col("numbers_to_select"),
        F.col("min_number"),
        F.col("max_number"),
        F.col("super_number"),
        F.col("super_min"),
        F.col("super_max"),
    )
    return ruled.select("lottery_id", "draw_number", ok.alias("valid"))


SETS = """
sets AS (
  SELECT b.lottery_id, b.draw_number, string_agg(cast(m.number AS varchar), ',' ORDER BY m.number) AS numbers
  FROM baskets b JOIN members m ON m.draw_number = b.draw_number GROUP BY 1, 2)"""


@job(
    "dedupe_combinations",
    f"{SETS} SELECT lottery_id, numbers, min(draw_number) AS attempt FROM sets GROUP BY 1, 2",
)
def _(t):
    rows = t.baskets.select("lottery_id", F.col("draw_number").alias("attempt"), "numbers")
    out = sampling.dedupe_combinations(rows, ["lottery_id"])
    return out.select("lottery_id", F.col("set").alias("numbers"), "attempt")


@job(
    "list_generated",
    "SELECT lottery_id, draw_number AS version, draw_date AS made_on FROM baskets WHERE lottery_id = 4",
)
def _(t):
    made = t.baskets.where("lottery_id = 4").select(
        "lottery_id", F.col("draw_number").alias("version"), F.col("draw_date").alias("made_on")
    )
    return sampling.list_generated(made)
