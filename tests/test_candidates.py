"""Candidates of any estimator against fits one by one."""

import numpy as np
import pytest

from urnframe.operators import candidates, classifiers
from test_training import rows_of


def _value(metric, said, was):
    said, was = np.array(said, bool), np.array(was, bool)
    both = (said & was).sum()
    top, bottom = {
        "accuracy": ((said == was).sum(), len(was)), "precision": (both, said.sum()), "recall": (both, was.sum()),
        "f1": (2 * both, said.sum() + was.sum()),
    }[metric]
    return top / bottom if bottom else 0.0


@pytest.mark.parametrize("metric, minimise", [("f1", False), ("accuracy", True)])
def test_forests_of_every_candidate(spark, metric, minimise):
    rows = rows_of(spark, 120)
    wanted = [(1, 3), (1, 4), (2, 3), (2, 9)]
    space = [(1, 1, 1, 3), (1, 2, 4, 7), (2, 1, 2, 5)]
    models = spark.createDataFrame(wanted, "lottery_id int, number int")
    grid = spark.createDataFrame(space, "lottery_id int, eval_num bigint, depth int, trees int")
    got = candidates.evaluate_models(rows, models, grid, "random_forest", metric, minimise, block=7)
    data = rows.orderBy("draw_number").collect()
    want = {}
    for lottery, eval_num, depth, trees in space:
        values = []
        for number in (n for i, n in wanted if i == lottery):
            own = [(r.segment, np.array(r.features), number in r.next_numbers) for r in data if r.lottery_id == lottery]
            x = {s: np.stack([f for g, f, _ in own if g == s]) for s in ("train", "eval")}
            y = {s: np.array([float(v) for g, _, v in own if g == s]) for s in ("train", "eval")}
            model = classifiers.fit("random_forest", x["train"], y["train"], depth=depth, trees=trees)
            values.append(_value(metric, classifiers.score(model, x["eval"])[1], y["eval"]))
        want[lottery, eval_num] = round(np.mean(values), 8) * (-1 if minimise else 1)
    assert {(r.lottery_id, r.eval_num): pytest.approx(r.fitness) for r in got.collect()} == want
    with pytest.raises(ValueError):
        candidates.fitness(got, "loss")


@pytest.mark.parametrize("metric", list(candidates.METRICS))
def test_neighbours_of_every_candidate(spark, metric):
    rng = np.random.default_rng(2)
    near = [(1, d, r, int(n)) for d in range(100, 120) for r, n in enumerate(rng.choice(60, 6, replace=False), 1)]
    after = [(1, d, sorted(rng.choice(6, 3, replace=False).tolist())) for d in [*range(60), *range(100, 119)]]
    nexts = spark.createDataFrame(after, "lottery_id int, draw_number bigint, next_numbers array<int>")
    neighbors = spark.createDataFrame(near, "lottery_id int, draw_number bigint, rank bigint, neighbor bigint")
    space = [(1, 1, 1), (1, 2, 2), (1, 3, 5)]
    grid = spark.createDataFrame(space, "lottery_id int, eval_num bigint, k int")
    models = spark.createDataFrame([(1, n) for n in range(7)], "lottery_id int, number int")
    got = candidates.evaluate_knn(neighbors, nexts, grid, models, metric).collect()
    known = {d: set(n) for _, d, n in after}
    want = {}
    for _, eval_num, k in space:
        values = []
        for number in range(7):
            asked = [d for d in range(100, 119)]
            said = [2 * sum(number in known[n] for _, d, r, n in near if d == draw and r <= k) >= k for draw in asked]
            values.append(_value(metric, said, [number in known[d] for d in asked]))
        want[1, eval_num] = round(np.mean(values), 8)
    assert {(r.lottery_id, r.eval_num): pytest.approx(r.fitness) for r in got} == want
