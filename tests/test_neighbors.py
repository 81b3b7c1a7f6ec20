"""Grid search for neighbours against brute force, with equal vectors and outliers."""

import random

import pytest
from pyspark.sql import functions as F

from urnframe.operators.features import FEATURE_ORDER
from urnframe.operators.neighbors import nearest


def test_nearest_equals_brute_force(spark):
    rng = random.Random(2)

    def vector(spread):
        return tuple(float(rng.randint(0, spread)) for _ in FEATURE_ORDER)

    hot = vector(9)
    train = [(1, i, *(hot if i % 3 == 0 else vector(30))) for i in range(240)]
    train += [(2, i, *vector(30)) for i in range(4)]  # fewer than k in this lottery
    wanted = [(1, 1000 + i, *vector(30)) for i in range(25)] + [(1, 1100, *hot), (1, 1101, *hot)]
    wanted += [(1, 1200, *([500.0] * len(FEATURE_ORDER))), (2, 1300, *vector(30))]
    schema = "lottery_id int, draw_number bigint, " + ", ".join(f"{c} double" for c in FEATURE_ORDER)
    out = nearest(spark.createDataFrame(train, schema), spark.createDataFrame(wanted, schema), k=5)
    got = {}
    for r in out.orderBy("lottery_id", "draw_number", "rank").collect():
        got.setdefault((r.lottery_id, r.draw_number), []).append(r.neighbor)
    for lottery_id, draw, *x in wanted:
        near = sorted(
            (sum((a - b) ** 2 for a, b in zip(x, row[2:])), row[1]) for row in train if row[0] == lottery_id
        )
        assert got[(lottery_id, draw)] == [d for _, d in near[:5]]


def test_draws_are_not_broadcast(spark):
    schema = "lottery_id int, draw_number bigint, " + ", ".join(f"{c} double" for c in FEATURE_ORDER)
    rows = spark.createDataFrame([(1, i, *([float(i)] * len(FEATURE_ORDER))) for i in range(20)], schema)
    out = nearest(rows.where("draw_number < 15"), rows.where("draw_number >= 15"), k=2)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("leaf, each", [(8, 3), (40, 8192)])
def test_leaves_and_their_neighbours_equal_brute_force(spark, leaf, each):
    rng = random.Random(3)

    def vector():
        return tuple(rng.choice((float(rng.randint(0, 6)), rng.randint(0, 20) / 3)) for _ in FEATURE_ORDER)

    train = [(j, i, *vector()) for j in (1, 2) for i in range(300)] + [(3, 1, *vector())]
    wanted = [(j, 1000 + i, *vector()) for j in (1, 2, 3, 4) for i in range(40)] + [(1, 2000, *([-90.0] * len(FEATURE_ORDER)))]
    schema = "lottery_id int, draw_number bigint, " + ", ".join(f"{c} double" for c in FEATURE_ORDER)
    out = nearest(spark.createDataFrame(train, schema), spark.createDataFrame(wanted, schema), 4, leaf, each)
    got = {}
    for r in out.orderBy("lottery_id", "draw_number", "rank").collect():
        got.setdefault((r.lottery_id, r.draw_number), []).append(r.neighbor)
    for lottery_id, draw, *x in wanted:
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(x, row[2:])), 9), row[1]) for row in train if row[0] == lottery_id)
        assert got.get((lottery_id, draw), []) == [d for _, d in near[:4]]


def test_pairs_are_no_rows(spark):
    """The search returns about k rows per vector; before, every pair of neighbouring cells was one."""
    rng = random.Random(4)
    schema = "lottery_id int, draw_number bigint, " + ", ".join(f"{c} double" for c in FEATURE_ORDER)
    rows = spark.createDataFrame([(1, i, *[float(rng.randint(0, 9)) for _ in FEATURE_ORDER]) for i in range(200)], schema)
    out = nearest(rows.where("draw_number < 150"), rows.where("draw_number >= 150"), k=2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "POWER" not in plan and "d2 <= within" not in plan
