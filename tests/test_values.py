"""Hand-computed values of single operators."""

import math

import pytest
from pyspark.sql import functions as F

from urnframe.operators import (
    backtest,
    experiments,
    features,
    identity,
    metrics,
    probability,
    ranking,
    sampling,
    search,
    stats,
    text,
    training,
)


def one(df, name):
    return df.first()[name]


def test_hypergeometric(spark):
    params = spark.createDataFrame([(9, 5, 3)], "pool int, picks int, good int")
    got = [r.probability for r in probability.hypergeometric(params).orderBy("k").collect()]
    assert got == pytest.approx([1 / 21, 5 / 14, 10 / 21, 5 / 42, 0, 0])


def test_binomial_and_poisson_sum(spark):
    b = spark.createDataFrame([(10, 0.5)], "trials int, p double")
    assert one(probability.binomial(b).agg(F.sum("probability").alias("s")), "s") == pytest.approx(1)
    p = spark.createDataFrame([(2.0, 10)], "lam double, kmax int")
    first = probability.poisson(p).where("k = 0")
    assert one(first, "probability") == pytest.approx(math.exp(-2))


def test_bayes(spark):
    schema = "lottery_id int, number int, value double"
    prior = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5)], schema)
    likelihood = spark.createDataFrame([(1, 0, 0.8), (1, 1, 0.2)], schema)
    got = {r.number: r.value for r in probability.bayes_posterior(prior, likelihood).collect()}
    assert got == pytest.approx({0: 0.8, 1: 0.2})
    none = likelihood.withColumn("value", F.lit(0.0))
    assert probability.bayes_posterior(prior, none).count() == 0


def test_conditional(baskets_of):
    draws = baskets_of(*[(i, [7, 10 + i] if i % 5 < 2 else [8, 10 + i]) for i in range(20)])
    got = {r.number: r.value for r in probability.conditional(draws).collect()}
    assert got[7] == pytest.approx(0.4)


def test_basket_features(baskets_of, rules_of):
    draws = baskets_of((1, [1, 4, 7]), (2, [5, 3, 8]), (3, [2, 3, 5, 8]), (4, [1, 44]), (5, [5, 6, 12]))
    got = {r.draw_number: r for r in features.basket_features(draws, rules_of()).collect()}
    assert (got[1].draw_sum, got[1].draw_mean) == (12, 4)
    assert got[2].draw_range == 5
    assert got[3].odd_even_ratio == 1
    assert got[4].low_high_ratio == 1
    assert got[5].consecutive_count == 1


def test_series_features(baskets_of, rules_of):
    draws = baskets_of((9, [3, 7, 44]), (10, [3, 9, 44]))
    repeated = {r.draw_number: r.repeated_from_previous for r in features.repeated_from_previous(draws).collect()}
    assert repeated == {9: 0, 10: 2}
    gaps = features.max_current_gap(baskets_of((1, [1]), (5, [2]), (12, [1])), rules_of(1, 3))
    assert {r.draw_number: r.max_current_gap for r in gaps.collect()} == {1: 0, 5: 4, 12: 11}
    decades = features.decade_distribution(baskets_of((1, [7, 15, 42])))
    assert one(decades, "decades") == {1: 1, 11: 1, 41: 1}
    counts = features.current_frequency_map(baskets_of((1, [7]), (4, [7, 9]), (9, [7])))
    assert counts.where("draw_number = 9").first().current_frequency == {7: 3, 9: 1}


def test_gap_summary(baskets_of):
    draws = baskets_of((1, [1, 2]), (3, [2]), (4, [1]), (9, [1]))
    got = {r.number: tuple(r)[2:] for r in stats.gap_summary(draws).collect()}
    assert got[1] == (2, 1, 2, 1.5)
    assert got[2] == (1, 1, 1, 1.0)
    once = stats.gap_summary(baskets_of((1, [5]), (2, [6])))
    assert {tuple(r)[2:] for r in once.collect()} == {(0, None, None, None)}


def test_entropy(spark, rules_of):
    counts = spark.createDataFrame([(1, 1, 2), (1, 2, 2)], "lottery_id int, number int, n bigint")
    assert one(stats.entropy_base2(counts, rules_of(1, 9)), "entropy") == 1
    assert one(stats.entropy_base2(counts.limit(0), rules_of(1, 9)), "entropy") == 0


def predictions(spark, rows):
    return spark.createDataFrame(
        [("m", i, *r) for i, r in enumerate(rows)],
        "model string, draw_number bigint, label int, prediction int, score double",
    )


def test_classification_metrics(spark):
    rows = predictions(spark, [(1, 1, 0.9), (0, 1, 0.8), (1, 0, 0.3), (0, 0, 0.1)])
    got = metrics.classification_metrics(rows, ["model"]).first()
    assert (got.accuracy, got.precision, got.recall, got.f1) == (0.5, 0.5, 0.5, 0.5)
    quiet = predictions(spark, [(0, 0, 0.1), (0, 0, 0.2)])
    assert metrics.classification_metrics(quiet, ["model"]).first().precision == 1
    assert metrics.classification_metrics(quiet, ["model"], 0.0).first().precision == 0


def test_auc(spark):
    rows = predictions(spark, [(1, 1, 0.9), (0, 1, 0.5), (1, 0, 0.5), (0, 0, 0.1)])
    assert one(metrics.roc_auc(rows, ["model"]), "roc_auc") == pytest.approx(0.875)
    assert one(metrics.trapezoid_auc(rows, ["model"]), "roc_auc") == pytest.approx(0.75)
    single = predictions(spark, [(1, 1, 0.9)])
    assert one(metrics.roc_auc(single, ["model"]), "roc_auc") == 0.5


def test_quantize(spark):
    row = spark.createDataFrame([(0.123456789,)], "value double")
    assert str(one(metrics.quantized(row), "value")) == "0.12345679"


def test_window_metrics(spark):
    rows = spark.createDataFrame(
        [(1, "p", w, d, m) for w, d, m in [(0, 1, 0), (0, 2, 2), (1, 3, 1), (1, 4, 1)]],
        "lottery_id int, predictor string, window bigint, draw_number bigint, matches bigint",
    )
    per_window = backtest.window_metrics(rows)
    got = {r.window: (r.hit_rate, r.average_matches, r.consistency_score) for r in per_window.collect()}
    assert got == {0: (0.5, 1.0, 1.0), 1: (1.0, 1.0, 0.0)}
    total = backtest.aggregate_windows(per_window).first()
    assert total.hit_rate == 0.75
    assert total.consistency_score == pytest.approx(math.sqrt(0.5), abs=1e-8)


def test_data_floor(spark):
    counts = spark.createDataFrame([(1, 50, 20)], "lottery_id int, draws bigint, train_count bigint")
    with pytest.raises(ValueError):
        backtest.check_data_floor(counts)


def test_allocation(spark):
    schema = "lottery_id int, score double, rank bigint"
    entries = spark.createDataFrame([(1, 0.5, 1), (1, 0.3, 2), (1, 0.2, 3)], schema)
    got = {r["rank"]: r.allocated for r in sampling.allocate_count(entries, 7).collect()}
    assert got == {1: 4, 2: 2, 3: 1}
    with pytest.raises(Exception, match="zero"):
        sampling.allocate_count(entries.withColumn("score", F.lit(0.0)), 7).collect()


def test_sampling_is_valid_and_distinct(spark, rules_of):
    entries = spark.createDataFrame(
        [(1, 1, 6), (1, 2, 4)], "lottery_id int, rank int, allocated bigint"
    )
    pool = spark.createDataFrame(
        [(1, r, n, 1.0) for r in (1, 2) for n in range(1, 6)],
        "lottery_id int, rank int, number int, weight double",
    )
    rules = rules_of(1, 5, 2)
    rows = sampling.sample_combinations(entries, pool, rules, seed=1).collect()
    sets = [tuple(r.numbers) for r in rows]
    assert len(sets) == len(set(sets)) == 10  # every pair of five numbers
    with pytest.raises(ValueError, match="exhausted"):
        more = entries.withColumn("allocated", F.lit(8).cast("long"))
        sampling.sample_combinations(more, pool, rules, seed=1, tries=500)


def test_ranking(spark):
    rows = [
        (1, "ml", "a", "precision", 0.2),
        (1, "ml", "b", "precision", 0.6),
        (1, "ml", "a", "consistency_score", 1.0),
        (1, "ml", "b", "consistency_score", 3.0),
        (1, "bt", "c", "hit_rate", 0.4),
    ]
    df = spark.createDataFrame(
        rows, "lottery_id int, engine_type string, model_id string, metric_name string, value double"
    )
    wide = {r.model_id: r for r in ranking.normalize_metrics(df).collect()}
    assert (wide["a"].precision, wide["b"].precision) == (0, 1)
    assert (wide["a"].consistency_score, wide["b"].consistency_score) == (1, 0)
    assert (wide["c"].hit_rate, wide["c"].recall) == (1, 0)
    with pytest.raises(ValueError):
        ranking.composite_score(df, {"hit_rate": 0.0})


def test_fold_of_duplicates(spark):
    schema = "lottery_id int, engine_type string, snapshot_id bigint, model_id string, seq bigint, metric_name string, value double"
    rows = [(1, "ml", 1, "m", i, "f1", float(v)) for i, v in enumerate([8, 4, 2, 1])]
    df = spark.createDataFrame(rows, schema)
    assert one(experiments.merge_duplicate_metrics(df), "value") == 3.75
    assert one(experiments.merge_duplicate_metrics(df, fold=True), "value") == 2.5


def test_early_stop(spark):
    schema = "lottery_id int, eval_num bigint, fitness double"
    df = spark.createDataFrame([(1, i + 1, f) for i, f in enumerate([1.0, 3.0, 2.0, 2.0, 2.0, 9.0])], schema)
    history = search.convergence_history(df)
    assert search.early_stop_at(history, 3).first().stop_at == 4
    assert search.best_candidate(df).first().eval_num == 6
    with pytest.raises(ValueError):
        search.check_space({"x": {"type": "integer", "low": 3, "high": 3}})


def test_intents_and_folding(spark):
    df = spark.createDataFrame(
        [("¿Por qué salió así?",), ("Haz un INFORME",), ("Resumen de la gráfica",), ("hola",)], "q string"
    )
    got = [r[0] for r in df.select(text.classify_intent(F.col("q"))).collect()]
    assert got == ["explain", "report", "summarize", "unknown"]
    folded = df.select(text.fold_text(F.col("q"))).first()[0]
    assert folded == "¿por que salio asi?"


def test_fingerprint_ignores_order_and_partitions(spark):
    df = spark.range(500).selectExpr("id", "id % 7 as v")
    a = one(identity.table_fingerprint(df, ["id", "v"]), "fingerprint")
    b = one(identity.table_fingerprint(df.orderBy(F.desc("id")).repartition(7), ["id", "v"]), "fingerprint")
    c = one(identity.table_fingerprint(df.unionAll(df.limit(1)), ["id", "v"]), "fingerprint")
    assert a == b != c


def test_split_guards(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2)], "lottery_id int, draw_number bigint")
    cuts = spark.createDataFrame([(1, 9)], "lottery_id int, cut bigint")
    with pytest.raises(ValueError):
        training.require_both_sides(training.walk_forward_split(rows, cuts))
