"""Chunked scans against plain Python, with chunks small enough to be crossed often."""

import random

import pytest
from pyspark.sql import functions as F

from urnframe.plans.series import dense_index, framed, running, total_rank


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [(g, k, rng.choice([None, 1, 2, 7])) for g in (1, 2) for k in rng.sample(range(500), 90)]
    return spark.createDataFrame(data, "g int, k bigint, v bigint"), data


@pytest.mark.parametrize("levels", [1, 2])
def test_running_matches_plain(rows, levels):
    df, data = rows
    specs = {
        "n": ("sum", F.lit(1).cast("long")),
        "low": ("min", F.col("v")),
        "high": ("max", F.col("v")),
        "seen": ("last", F.col("v")),
    }
    got = {
        (r.g, r.k): (r.n, r.low, r.high, r.seen)
        for r in running(df, ["g"], "k", specs, exclusive=True, bits=3, levels=levels).collect()
    }
    for g in (1, 2):
        before = []
        for _, k, v in sorted(x for x in data if x[0] == g):
            known = [x for x in before if x is not None]
            want = (
                len(before),
                min(known, default=None),
                max(known, default=None),
                known[-1] if known else None,
            )
            assert got[(g, k)] == want
            before.append(v)


def test_inclusive_sum_and_negative_keys(spark):
    df = spark.createDataFrame([(1, -k, 2) for k in range(40)], "g int, k bigint, v bigint")
    out = running(df, ["g"], "k", {"s": ("sum", F.col("v"))}, bits=2).collect()
    assert {r.k: r.s for r in out} == {-k: 2 * (40 - k) for k in range(40)}


def test_dense_index_without_series_key(spark):
    df = spark.createDataFrame([(k * k,) for k in range(30)], "k bigint")
    out = dense_index(df, [], "k", bits=4).collect()
    assert {r.k: r.idx for r in out} == {k * k: k for k in range(30)}


def test_framed_sees_rows_of_the_chunk_before(spark):
    df = spark.createDataFrame([(1, i, i * i) for i in range(50)], "g int, i bigint, x bigint")

    def build(window):
        return {"s": F.sum("x").over(window.rowsBetween(-3, 0))}

    out = framed(df, ["g"], "i", 3, build, bits=3).collect()
    assert len(out) == 50
    for r in out:
        assert r.s == sum(j * j for j in range(max(0, r.i - 3), r.i + 1))


def test_total_rank_breaks_ties(spark):
    data = [(1, i % 3, i) for i in range(20)]
    df = spark.createDataFrame(data, "g int, score bigint, tie bigint")
    got = {r.tie: r["rank"] for r in total_rank(df, ["g"], "score", "tie", bits=2).collect()}
    for place, (_, _, tie) in enumerate(sorted(data), 1):
        assert got[tie] == place
