import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from urnframe.operators import classifiers, extras, training
from urnframe.operators.features import FEATURE_ORDER


def rows_of(spark, n=200):
    """Numbers 3 and 4 of lottery 1 follow the first two features; lottery 2 never has number 9."""
    rng = np.random.default_rng(1)
    data = []
    for lottery, draw in itertools.product((1, 2), range(n)):
        x = rng.integers(0, 10, len(FEATURE_ORDER)).astype(float).tolist()
        nexts = [k for k, on in ((3, x[0] > 4), (4, x[1] > 6)) if on]
        data.append((lottery, draw, "train" if draw < n * 4 // 5 else "eval", nexts, x))
    return spark.createDataFrame(
        data, "lottery_id int, draw_number bigint, segment string, next_numbers array<int>, features array<double>"
    )


@pytest.mark.parametrize("family", classifiers.FAMILIES)
def test_every_number_gets_a_model(spark, family):
    wanted = [(1, 3), (1, 4), (2, 3), (2, 9)]
    models = spark.createDataFrame(wanted, "lottery_id int, number int")
    got = training.train_family(family, rows_of(spark), models).toPandas()
    assert sorted(set(zip(got.lottery_id, got.number))) == wanted
    assert (got.groupby(["lottery_id", "number"]).size() == 40).all()
    right = (got.label == got.prediction).groupby([got.lottery_id, got.number]).mean()
    assert (right > 0.9).all() and right[(2, 9)] == 1.0


def test_blocks_and_the_sample_keep_all_evaluation_rows(spark):
    rows = rows_of(spark)
    models = spark.createDataFrame([(1, 3), (2, 4)], "lottery_id int, number int")
    fitted = training.fit_models(rows, models, "svm", fit_rows=80).cache()
    one = training.score_rows(rows, fitted).orderBy("lottery_id", "draw_number").collect()
    many = training.score_rows(rows, fitted, block=7).orderBy("lottery_id", "draw_number").collect()
    assert len(one) == len(many) == 80
    assert [r[:4] for r in one] == [r[:4] for r in many]
    assert np.allclose([r.score for r in one], [r.score for r in many])


def test_targets_are_all_numbers_seen(baskets_of):
    baskets = baskets_of((1, [1, 2]), (2, [2, 3]), (3, [9]))
    got = training.targets_of(baskets).orderBy("number").collect()
    assert [tuple(r) for r in got] == [(1, n) for n in (1, 2, 3, 9)]
    assert training.sequence_models(baskets).count() == len(training.SEQUENCE_TARGETS)


def test_lasso_rows_stand_for_every_number(spark, baskets_of):
    baskets = baskets_of((1, [1, 2]), (2, [2, 3]), (3, [2, 9]))
    features = baskets.select("lottery_id", "draw_number", *[F.lit(1).alias(c) for c in FEATURE_ORDER])
    rows = extras.lasso_rows(features, training.next_numbers(baskets), training.targets_of(baskets))
    weights = {r.label: r.w for r in rows.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    assert weights == {1.0: 4.0, 0.0: 4.0}  # two labelled draws, four numbers
