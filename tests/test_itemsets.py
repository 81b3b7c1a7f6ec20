"""Frequent sets and rules with a least count per lottery, against enumeration."""

import random
from collections import Counter
from itertools import combinations

import pytest

from urnframe.operators import extras


def _enumerated(rows, support):
    sizes = Counter(r[0] for r in rows)
    seen = Counter()
    for lottery, _, numbers in rows:
        own = sorted(set(numbers))
        for k in range(1, len(own) + 1):
            seen.update((lottery, c) for c in combinations(own, k))
    return {(i, c): n for (i, c), n in seen.items() if n >= -(-support * sizes[i] // 1)}, sizes


def test_a_small_lottery_beside_a_hot_one_keeps_its_sets_and_rules(spark):
    hot = [(1, i, [i % 40 + 1, (i * 7) % 40 + 51]) for i in range(400)]
    small = [(2, i, [1, 2] if i < 6 else [3, 4 + i]) for i in range(10)]
    baskets = spark.createDataFrame(hot + small, "lottery_id int, draw_number bigint, numbers array<int>")
    sets = extras.frequent_itemsets(baskets, 0.5)
    assert {(r.lottery_id, tuple(r["items"]), r.freq) for r in sets.collect()} == {(2, (1,), 6), (2, (2,), 6), (2, (1, 2), 6)}
    rules = extras.association_rules(baskets, sets).collect()
    got = {(r.antecedent[0], r.consequent, round(r.confidence, 6), round(r.lift, 6), round(r.support, 6)) for r in rules}
    assert got == {(1, 2, 1.0, 1.666667, 0.6), (2, 1, 1.0, 1.666667, 0.6)}


@pytest.mark.parametrize("support", [0.02, 0.1, 0.34])
def test_sets_and_rules_equal_enumeration(spark, support):
    rng = random.Random(7)
    rows = [(1, i, rng.choices(range(1, 9), k=rng.randint(0, 6))) for i in range(150)]
    rows += [(2, i, [1, 2, 3, 4, 5, 6] if i % 2 else rng.sample(range(1, 30), 3)) for i in range(12)]
    rows += [(3, 1, []), (4, 1, [7])]
    baskets = spark.createDataFrame(rows, "lottery_id int, draw_number bigint, numbers array<int>")
    want, sizes = _enumerated(rows, support)
    sets = extras.frequent_itemsets(baskets, support)
    assert {(r.lottery_id, tuple(r["items"])): r.freq for r in sets.collect()} == want
    rules = {}
    for (i, c), n in want.items():
        for x in c if len(c) > 1 else ():
            rest = tuple(y for y in c if y != x)
            sure = n / want[i, rest]
            if sure >= 0.1:
                rules[i, rest, x] = (round(sure, 9), round(sure * sizes[i] / want[i, (x,)], 9), round(n / sizes[i], 9))
    got = extras.association_rules(baskets, sets).collect()
    assert {
        (r.lottery_id, tuple(r.antecedent), r.consequent): (round(r.confidence, 9), round(r.lift, 9), round(r.support, 9)) for r in got
    } == rules


def test_no_baskets(spark):
    none = spark.createDataFrame([], "lottery_id int, draw_number bigint, numbers array<int>")
    assert extras.frequent_itemsets(none, 0.1).count() == 0
