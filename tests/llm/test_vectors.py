"""Multi-index search against brute force."""

import numpy as np
import pytest

from urnframe.llm import multi_index


def test_search_finds_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 8))
    x[100:160] = x[3]  # a group of copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(600, None), (601, [0.0] * 8), (602, [float("nan")] * 8), (603, [1.0, None] * 4), (None, [1.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = multi_index.search(vectors, vectors.where("vec_id % 20 = 0"), k=10, centroids=4, block=100).collect()
    kept = np.array([np.array(v, np.float32) for v in x]).astype(float)
    asked = {}
    for r in got:
        asked.setdefault(r.query_id, []).append(r)
    assert set(asked) == set(range(0, 600, 20))
    hits = 0
    for q, answers in asked.items():
        answers.sort(key=lambda r: r.rank)
        assert [r.rank for r in answers] == list(range(1, 11))
        score = (kept[q] * kept).cumsum(1)[:, -1]
        assert np.allclose([r.score for r in answers], score[[r.vec_id for r in answers]])
        assert all((a.score, -a.vec_id) > (b.score, -b.vec_id) for a, b in zip(answers, answers[1:]))
        score[q] = -np.inf
        want = np.lexsort((np.arange(600), -score))[:10]
        hits += len({r.vec_id for r in answers} & set(want.tolist()))
    assert hits >= 0.9 * 10 * len(asked)


@pytest.mark.parametrize("block", [40, 4096])
def test_measured_budget_follows_the_data(spark, block):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16)) * 6
    x = (centres[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 16))).astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    asked = vectors.where("vec_id % 20 = 0")
    got = {}
    for r in multi_index.search(vectors, asked, k=10, block=block).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 1500, 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(got[q] & set(np.lexsort((np.arange(1500), -score))[:10].tolist()))
    assert hits >= 0.9 * 10 * 75
    entries = multi_index.clean(vectors)
    books = multi_index.fit(entries, 12)
    entered = multi_index.with_cells(entries, books)
    sizes = np.zeros(144, np.int64)
    for r in entered.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    share = multi_index.measured_budget(entered, multi_index.clean(asked), books, sizes, 10)
    assert 0 < share < 0.4  # clustered data need little


def test_buckets_hold_whole_cells():
    sizes = np.array([3, 0, 9, 50, 1, 1, 30, 2])
    bucket, parts = multi_index.buckets_of(sizes, 4, 10)
    assert bucket.tolist() == [0, 0, 1, 2, 3, 3, 4, 5] and parts.tolist() == [1, 1, 5, 1, 3, 1]


def test_few_vectors(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (1, [0.5, 1.0])], "vec_id bigint, embedding array<float>")
    got = multi_index.search(two, two.where("vec_id = 0")).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.5)]
    assert multi_index.search(two.limit(0), two).count() == 0


def test_heap_visits_pairs_in_order():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=5), rng.normal(size=6)
    seen = multi_index.visit(a, b, np.ones(30, np.int64), 30)
    sums = (a[:, None] + b[None, :]).ravel()
    assert sorted(seen) == list(range(30)) and (np.diff(sums[seen]) <= 0).all()
