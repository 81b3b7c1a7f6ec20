"""Fill-in-middle and the factorisation machine against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from urnframe.llm import fim, quality_fm


def _want(doc_id, text):
    text = text or ""
    n = len(text)
    name = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(name[i : i + 8], 16) for i in (0, 8, 16, 24))
    low, high = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    sizes = (low, high - low)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        form, out, sizes = "plain", text, (None, None)
    elif h4 % 100 < 20:
        form, out = "spm", "<S>" + suffix + "<P>" + prefix + "<M>" + middle
    else:
        form, out = "psm", "<P>" + prefix + "<S>" + suffix + "<M>" + middle
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, form, *sizes, sha(out), sha(text))


def _texts():
    rng = random.Random(9)
    rows = [(i, "".join(rng.choices("ab <PSM>\né🙂", k=rng.randint(0, 60)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "a<P>b"), (303, "<P<S"), (None, "no id"), (None, None), (304, "x" * 200_001 + "é🙂" * 5)]
    return rows + [rows[3], rows[3], (3, "another text of an id")]


@pytest.mark.parametrize("chunk", [fim.CHUNK, 1, 7])
def test_fill_in_middle_is_exact(spark, chunk):
    rows = _texts() if chunk != 1 else [r for r in _texts() if len(r[1] or "") < 1000]
    docs = spark.createDataFrame([(*r, 5, "p") for r in rows], "doc_id bigint, text string, slot int, piece string").repartition(3)
    got = fim.fill_in_middle(docs, chunk=chunk).collect()
    assert Counter(map(tuple, got)) == Counter(_want(*r) for r in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_assembled_outputs_are_texts(spark):
    rows = [(i, t) for i, t in _texts() if i is not None and i < 100 and t][:90]
    out = fim.assembled(spark.createDataFrame(rows, "doc_id bigint, text string"), chunk=5).collect()
    joined = {}
    for r in out:
        assert r.at == len(joined.get(r.slot, (0, ""))[1])
        joined[r.slot] = (r.doc_id, joined.get(r.slot, (0, ""))[1] + r.piece)
    assert Counter((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in joined.values()) == Counter(
        (w[0], w[5]) for w in (_want(*r) for r in rows)
    )


def test_pair_sum_in_linear_time():
    rng = np.random.default_rng(2)
    m = quality_fm.Machine()
    m.w0, m.w = 0.3, rng.normal(size=quality_fm.FEATURES)
    m.v = rng.normal(size=m.v.shape)
    row = np.repeat(np.arange(5), [1, 4, 9, 2, 30])
    feature = np.concatenate([rng.choice(quality_fm.FEATURES, n, replace=False) for n in (1, 4, 9, 2, 30)])
    value = rng.normal(size=len(row))
    got, _ = m.sums(row, feature, value, 5)
    for r in range(5):
        f, x = feature[row == r], value[row == r]
        pairs = sum(m.v[f[i]] @ m.v[f[j]] * x[i] * x[j] for i in range(len(f)) for j in range(i))
        assert got[r] == pytest.approx(0.3 + m.w[f] @ x + pairs)


def test_machine_learns_pairs():
    """Labels that only a product of two features tells: no linear model does better than chance."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2, 1200), rng.integers(0, 2, 1200)
    data = [(np.array([5 + x, 9 + y]), np.ones(2)) for x, y in zip(a, b)]
    y = (a ^ b).astype(float)
    m = quality_fm.Machine().train(data[:800], y[:800], epochs=30)
    z = np.array([m.sums(np.zeros(2, int), f, x, 1)[0][0] for f, x in data[800:]])
    assert ((z > 0) == (y[800:] == 1)).mean() > 0.95


def _rows(n):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choices(words, k=rng.randint(20, 80)))
        kind = i % 10
        if kind == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if kind == 1:
            text = "\n".join([text[:30]] * 8)
        rows.append((i, text, "en", "s1", len(text)))
        labels.append((i, int(kind > 1)))
    return rows, labels


def test_quality_is_learnt_and_awkward_rows_scored(spark):
    rows, labels = _rows(500)
    rows += [(500, None, None, None, None), (501, "", "en", "s", 0), (None, "words without an id", None, None, 4), rows[7]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.withColumn("quality", F.lit("x")).withColumn("score", F.lit(1)).withColumn("stats", F.lit(2))
    marks = spark.createDataFrame(labels + [(0, 1), (None, 1), (3, None)], "doc_id bigint, quality int")
    model = quality_fm.fit(docs.where("doc_id < 350"), marks.where("doc_id < 350"))
    got = quality_fm.score_texts(docs, model).collect()
    assert len(got) == len(rows) and all(0 < r.score < 1 for r in got)
    held = [(r.score >= 0.5, r.doc_id % 10 > 1) for r in got if r.doc_id is not None and 350 <= r.doc_id < 500]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert len({r.score for r in got if r.doc_id == 7}) == 1
    # neither lang, source nor doc_id is an input
    other = docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("zz").alias("lang"), "n_chars")
    again = {r.doc_id: r.score for r in quality_fm.score_texts(other, model).collect()}
    assert all(again[r.doc_id + 1000] == pytest.approx(r.score) for r in got if r.doc_id is not None)
    none = quality_fm.fit(docs, marks.limit(0))
    assert {r.score for r in quality_fm.score_texts(docs, none).collect()} == {0.5}
    assert quality_fm.score_texts(docs.limit(0), model).count() == 0
    one = quality_fm.fit(docs.drop("n_chars"), marks.where("quality = 1"))
    assert min(r.score for r in quality_fm.score_texts(docs.drop("n_chars"), one).collect()) > 0.5
