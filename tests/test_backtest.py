"""Walk-forward windows over several draws a day, against plain Python."""

import datetime
import random
from collections import Counter
from statistics import median

import pytest

from urnframe.operators import backtest


def _draws(n, seed, days):
    rng = random.Random(seed)
    first = datetime.date(2020, 1, 1)
    dates = sorted(rng.choice(range(days)) for _ in range(n))
    numbers = rng.sample(range(1, 10 * n), n)
    return [(k, first + datetime.timedelta(d), sorted(rng.sample(range(1, 11), 3))) for k, d in zip(numbers, dates)]


@pytest.fixture(scope="module")
def history():
    return {1: _draws(400, 1, 60), 2: _draws(90, 2, 700), 3: [(5, datetime.date(2021, 5, 5), [1, 2, 3])]}


@pytest.fixture(scope="module")
def draws(spark, history):
    rows = [(i, *d) for i, own in history.items() for d in own]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "lottery_id int, draw_number bigint, draw_date date, numbers array<int>").repartition(5)


def _plan(history, years, evaluate, step):
    counts, windows, ordered = {}, {}, {}
    for i, own in history.items():
        own = ordered[i] = sorted(own, key=lambda d: (d[1], d[0]))
        gaps = [(b[1] - a[1]).days for a, b in zip(own, own[1:])]
        counts[i] = max(int(years * 365 / (median(gaps) or 1)), 1) if gaps else len(own)
        for w, start in enumerate(range(0, len(own), step)):
            edge = start + counts[i]
            while 0 < edge < len(own) and own[edge][1] == own[edge - 1][1]:
                edge += 1  # the rest of the last training day
            if edge + evaluate <= len(own):
                windows[i, w] = (start, edge, edge + evaluate)
    return counts, windows, ordered


def test_windows_of_all_draws(draws, history):
    years, evaluate, step = 0.1, 7, 5
    counts, windows, ordered = _plan(history, years, evaluate, step)
    got = backtest.train_count(draws, years)
    assert {(r.lottery_id, r.draws, r.train_count) for r in got.collect()} == {(i, len(ordered[i]), c) for i, c in counts.items()}
    indexed, planned = backtest.plan_windows(draws, years, evaluate, step, floor=1)
    assert {(r.lottery_id, r.draw_number): r.idx for r in indexed.collect()} == {
        (i, d[0]): n for i, own in ordered.items() for n, d in enumerate(own)
    }
    assert {(r.lottery_id, r.window): (r.train_from, r.eval_from, r.eval_to) for r in planned.collect()} == windows
    assert {i for i, _ in windows} == {1, 2}
    backtest.check_window_order(backtest.window_order(planned, indexed))
    evals = backtest.evaluation_rows(planned, indexed).collect()
    want = Counter((i, w, d[0]) for (i, w), (_, a, b) in windows.items() for d in ordered[i][a:b])
    assert Counter((r.lottery_id, r.window, r.draw_number) for r in evals) == want


@pytest.mark.parametrize("span", [1, 4, 32, 1000])
def test_training_counts(spark, draws, history, span):
    _, windows, ordered = _plan(history, 0.1, 7, 5)
    indexed, planned = backtest.plan_windows(draws, 0.1, 7, 5, floor=1)
    lottery = spark.createDataFrame([(1, 1, 10), (2, 2, 12), (3, 1, 10)], "lottery_id int, min_number int, max_number int")
    got = {(r.lottery_id, r.window, r.number): r.n for r in backtest.train_frequencies(planned, indexed, lottery, span).collect()}
    want = {}
    for (i, w), (a, b, _) in windows.items():
        seen = Counter(x for d in ordered[i][a:b] for x in d[2])
        want |= {(i, w, x): seen[x] for x in (range(1, 11) if i == 1 else range(2, 13))}
    assert got == want


def test_no_draws(draws):
    none = draws.limit(0)
    assert backtest.train_count(none, 1).count() == 0 and backtest.plan_windows(none, 1, 2, 3)[1].count() == 0
    with pytest.raises(ValueError):
        backtest.plan_windows(draws, 0.1, 7, 5, floor=100)
