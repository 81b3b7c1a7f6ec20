"""Toxicity calibration, pipeline stages and awkward columns and rows."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from urnframe.llm import calibration, line_spread, multi_index, pigeonhole, signature_join, toxicity
from urnframe.session import shared_dir


def test_calibration_of_overlapping_and_separated_labels():
    rng = np.random.default_rng(5)
    y = (rng.random(600) < 0.15).astype(int)
    for gap in (0.0, 1.0, 4.0, 200.0):
        z = rng.normal(size=600) * 3 + gap * y - 50
        a, b = calibration.platt(z, y)
        p = 1 / (1 + np.exp(-(a * z + b)))
        assert 0 < a < 10 and (np.argsort(p, kind="stable") == np.argsort(z, kind="stable")).all()
        assert p.mean() == pytest.approx(y.mean(), abs=0.02)
        assert 1e-4 < p.min() and p.max() < 1 - 1e-4
    a, b = calibration.platt(-3.0 * y + rng.normal(size=600), y)  # worthless logits
    assert a > 0 and 1 / (1 + np.exp(-b)) < 0.5
    assert np.isfinite(calibration.platt(np.zeros(5), np.array([0, 1, 0, 0, 0]))).all()


def test_threshold_parts_no_ties_and_spares_clean_rows():
    rng = np.random.default_rng(6)
    y = (rng.random(1000) < 0.1).astype(int)
    score = np.round(np.clip(rng.normal(0.3 + 0.4 * y, 0.15), 0, 1), 2)
    cut = toxicity._threshold(score, y)
    assert cut not in score and (score[y == 0] >= cut).mean() <= toxicity.CLEAN_LOSS and (score[y == 1] >= cut).mean() > 0.3
    assert toxicity._threshold(np.full(50, 0.4), np.arange(50) % 2) == 2.0  # one score: no cut
    assert toxicity._threshold(np.array([0.9, 0.1]), np.array([1, 0])) == 0.5
    assert toxicity._threshold(np.array([0.9, 0.1]), np.array([0, 0])) == 2.0


def _toxic_rows(n, seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        body = rng.choices(words, k=40)
        mark = int(i % 8 == 0)
        if mark and i % 24:  # a third of the toxic rows look clean
            body[rng.randrange(40)] = rng.choice(["vilest", "trashy"])
        rows.append((i, " ".join(body), "aa" if i % 3 else "bb", f"s{i % 4}", None))
        labels.append((i, mark))
    return rows, labels


def test_overlapping_classes_keep_clean_rows(spark):
    rows, labels = _toxic_rows(600)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    got = {r.doc_id: r.rejected for r in toxicity.rejected(docs, model).collect()}
    clean = [i for i, m in labels if not m]
    assert sum(not got[i] for i in clean) >= 0.95 * len(clean)
    marked = [i for i, m in labels if m and i % 24]
    assert sum(got[i] for i in marked) >= 0.8 * len(marked)
    assert len({r.score for r in toxicity.score_texts(docs, model).collect()}) > 500


def test_every_labelled_row_is_learnt_and_counted(spark):
    """Before, at most 2,500 texts of each label were, whatever the table."""
    rows, labels = _toxic_rows(5400)
    rows = [(i, " ".join(text.split()[:4]), lang) for i, text, lang, _, _ in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    marks = spark.createDataFrame(labels + [(8, 0), (-5, 1), (9, None)], "doc_id bigint, toxic int")
    known = toxicity._labelled(docs, marks).cache()
    assert known.count() == 5400
    share = {(r.fold, r.toxic): r["count"] for r in known.groupBy("fold", "toxic").count().collect()}
    for fold in range(toxicity.NETS):
        assert abs(share[fold, 1] - 225) <= 9 and abs(share[fold, 0] - 1575) <= 9
    start = [toxicity.Net(3 + k) for k in range(toxicity.NETS)]
    nets = toxicity._round(known, start, 9)
    counts = toxicity._counts(known, nets).groupBy("lang").sum("n", "p").collect()
    assert {r.lang: r["sum(n)"] for r in counts} == {"aa": 3600, "bb": 1800} and sum(r["sum(p)"] for r in counts) == 675
    texts = [text for _, text, _ in rows]
    z = toxicity.logits(nets, pa.array(texts))
    y = np.array([m for _, m in labels])
    bad = np.array([any(w in ("vilest", "trashy") for w in t.split()) for t in texts])
    assert z[bad].mean() > z[y == 0].mean()
    again = toxicity._round(known.repartition(7), start, 9)  # shards do not depend on partitions
    assert all((a.flat() == b.flat()).all() for a, b in zip(nets, again))


def test_counted_scores_are_those_of_rows():
    rng = np.random.default_rng(3)
    z = np.round(rng.normal(size=900), 1)
    y = (rng.random(900) < 1 / (1 + np.exp(-2 * z))).astype(int)
    pairs, times = np.unique(np.stack([z, y], 1), axis=0, return_counts=True)
    assert np.allclose(calibration.platt(pairs[:, 0], pairs[:, 1].astype(int), times), calibration.platt(z, y))
    assert toxicity._threshold(pairs[:, 0], pairs[:, 1], 0.1, times) == toxicity._threshold(z, y, 0.1)


AWKWARD = ["_text", "n_lines", "n_removed", "_k", "_gone", "_hit", "score", "rejected", "set_key", "component_id", "c0", "a.b"]


@pytest.fixture(scope="module")
def awkward(spark):
    rows, labels = _toxic_rows(80)
    rows = [(i, "all the same here and there\n" + t, *r) for i, t, *r in rows]
    rows += [rows[5], (200, rows[5][1], "aa", "s9", 3), (5, "words of another text that nobody copies", "aa", "s0", 1)]
    rows += [(None, None, None, None, None), (300, "", None, None, 0), (None, rows[5][1], "aa", "s1", 0)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, schema)
    return docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(AWKWARD))), labels, rows


def test_columns_of_any_name_stay(spark, awkward):
    docs, labels, rows = awkward
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    bench = spark.createDataFrame([(1, "words of another text that nobody copies")], "item_id bigint, text string")
    stages = [
        lambda d: toxicity.rejected(d, model, "_s", "_flag").drop("_s", "_flag"),
        lambda d: line_spread.without_boilerplate(d, sites=3),
        signature_join.one_of_each,
        lambda d: pigeonhole.without_contamination(d, bench),
    ]
    for stage in stages:
        out = stage(docs)
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all([r[c] for c in AWKWARD] == list(range(len(AWKWARD))) for r in got)


def test_one_of_each_by_id_and_set(awkward):
    docs, _, rows = awkward
    got = sorted(((r.doc_id, r.text) for r in signature_join.one_of_each(docs).collect()), key=str)
    want = {(i, t) for i, t, *_ in rows} - {(200, rows[5][1])}  # the copy goes, id 5 keeps both texts, once each
    assert got == sorted(want, key=str)


def test_repeated_copy_beside_clean_text_of_one_id(spark):
    text = "one two three four five six seven"
    rows = [(1, text), (1, text), (2, text), (2, "a clean text of the second id"), (2, text), (3, text.upper()), (3, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in signature_join.one_of_each(docs).collect())
    assert got == [(1, text), (2, "a clean text of the second id"), (3, "x y z")]


def test_vectors_of_another_length(spark):
    rows = [(i, [float(i), 1.0, 2.0]) for i in range(30)] + [(40, [1.0]), (60, [1.0, 2.0]), (20, [5.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = multi_index.search(vectors, vectors.where("vec_id % 20 = 0"), k=3).collect()
    assert {r.query_id for r in got} == {0, 20} and all(r.vec_id < 30 for r in got)


def test_pipeline_returns_rows(spark, tmp_path):
    import corpus_pipeline

    rows, labels = _toxic_rows(300)
    rows += [(400, rows[1][1], "aa", "s1", 0), (401, None, None, None, None), (402, "", "aa", "s2", 0), rows[7]]
    rows += [(403, rows[9][1] + " what is the longest river of them all", "aa", "s1", 0)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = spark.createDataFrame([(1, "What is the longest river of them all?")], "item_id bigint, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    kept = set(out["doc_id"])
    clean = {i for i, m in labels if not m}
    assert len(kept & clean) >= 0.95 * len(clean) and {401, 402} <= kept and not {400, 403} & kept
    assert (out.groupby("doc_id")["length"].sum() == out.groupby("doc_id")["doc_tokens"].first()).all()


def test_tables_of_the_way_are_deleted(spark):
    """What a stage no longer reads does not stay on the disk for the stages behind it."""
    folder = Path(shared_dir(spark).removeprefix("file:")) / "frames"
    folder.mkdir(exist_ok=True)
    words = [" ".join(f"w{i * j % 97}" for j in range(30)) for i in range(12)]
    docs = spark.createDataFrame([(i, x, "en") for i, x in enumerate(words + words[:3])], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(15)], "doc_id long, toxic int")
    before = set(folder.iterdir())
    toxicity.fit(docs, labels)
    assert set(folder.iterdir()) == before
    rest = signature_join.one_of_each(docs)
    assert len(set(folder.iterdir()) - before) <= 3
    assert {r.doc_id for r in rest.collect()} == set(range(12))
