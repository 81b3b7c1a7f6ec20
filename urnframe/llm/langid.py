"""Language identification by averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urnframe.llm.sampling import remainder, sample_ids
from urnframe.llm.store import table
from urnframe.llm.text import U64, Words, slices

BUCKETS = 1 << 15
SIZE = 16
SAMPLE = 1500  # training texts of each language at most
CLASSES = 256  # languages at most
GRAMS = (1, 2, 3, 4)


def word_buckets(words: Words, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subword buckets of words: which word, which bucket; whole word and runs of bytes."""
    of, keys = [np.arange(len(start))], [words.span(start, end, 11)]
    for n in GRAMS:
        word, key = words.grams(start, end, n, n)
        of.append(word)
        keys.append(key)
    return np.concatenate(of), (np.concatenate(keys) % U64(BUCKETS)).astype(np.int64)


def row_averages(words: Words, value: np.ndarray) -> np.ndarray:
    """Per row, the mean over its subwords of ``value[bucket]`` (zeros for a row without words).

    Each different word of the batch is looked up once.
    """
    rows = len(words.counts)
    out = np.zeros((rows, value.shape[1]))
    if not len(words.key):
        return out
    _, first, which = np.unique(words.key, return_index=True, return_inverse=True)
    of, bucket = word_buckets(words, words.start[first], words.end[first])
    uses = np.bincount(of, minlength=len(first))
    n = np.bincount(words.row, uses[which], rows)
    for k in range(value.shape[1]):
        total = np.bincount(of, value[bucket, k], len(first))
        out[:, k] = np.bincount(words.row, total[which], rows)
    return out / np.maximum(n, 1)[:, None]


def _features(batches: Iterator[pa.RecordBatch], target: str) -> Iterator[pa.RecordBatch]:
    """Sparse subword shares of each training text."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part["text"])
            bounds = np.concatenate([[0], np.cumsum(words.counts)])
            ids, shares = [], []
            for a, b in zip(bounds, bounds[1:]):
                _, bucket = word_buckets(words, words.start[a:b], words.end[a:b])
                count = np.bincount(bucket, minlength=1)
                own = np.flatnonzero(count)
                ids.append(own.astype(np.int32))
                shares.append((count[own] / max(1, len(bucket))).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part[target], pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
                ["doc_id", target, "ids", "shares"],
            )


def _dense(rows: list, at: np.ndarray) -> np.ndarray:
    x = np.zeros((len(at), BUCKETS), np.float32)
    for i, j in enumerate(at):
        x[i, rows[j][0]] = rows[j][1]
    return x


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(rows: list, label: np.ndarray, classes: int, epochs: int = 8, rate: float = 20.0) -> np.ndarray:
    """Stochastic gradient descent over embeddings and softmax weights.

    Returns the bucket table of logits: averaging commutes with the linear layer, so embeddings
    and weights are multiplied out once.
    """
    rng = np.random.default_rng(5)
    e = rng.normal(scale=1 / SIZE, size=(BUCKETS, SIZE)).astype(np.float32)
    w = np.zeros((SIZE, classes), np.float32)
    size = 32
    steps = epochs * -(-len(rows) // size)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), size):
            at = order[k : k + size]
            x = _dense(rows, at)
            used = np.flatnonzero(x.any(0))
            x = x[:, used]
            h = x @ e[used]
            g = _softmax(h @ w)
            g[np.arange(len(at)), label[at]] -= 1
            g *= rate * (1 - step / steps) / len(at)
            back = x.T @ (g @ w.T)
            w -= h.T @ g
            e[used] -= back
            step += 1
    return (e @ w).astype(np.float64)


def calibrate(logits: np.ndarray, label: np.ndarray, wanted: float = 0.99) -> tuple[float, float]:
    """A temperature that fits the confidences, and the lowest confidence to accept.

    Texts above it are right with a share of ``wanted`` on these rows.
    """
    grid = np.geomspace(0.1, 20, 40)
    losses = [-np.log(np.maximum(_softmax(logits * t)[np.arange(len(label)), label], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    p = _softmax(logits * temperature)
    right = p.argmax(1) == label
    order = np.argsort(-p.max(1), kind="stable")
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= wanted)
    threshold = float(p.max(1)[order[good[-1]]]) if len(good) else 1.0
    return temperature, min(threshold, 0.9)


def fit(docs: DataFrame, target: str = "lang", sample: int = SAMPLE) -> dict:
    """Learn from at most ``sample`` texts of each value of ``target`` in ``docs``.

    A fifth of the sample sets temperature and rejection. Without rows the model knows no value.
    """
    ids = F.broadcast(sample_ids(docs, target, sample, CLASSES).select("doc_id"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col(target).cast("string").alias(target))
    picked = rows.where(F.col(target).isNotNull()).join(ids, "doc_id").mapInArrow(
        lambda batches: _features(batches, target),
        f"doc_id bigint, {target} string, ids array<int>, shares array<float>",
    )
    got = picked.toArrow().sort_by([("doc_id", "ascending")])
    names = sorted(set(got[target].to_pylist()))
    if not names:
        return {"names": [], "logits": np.zeros((BUCKETS, 1)), "temperature": 1.0, "threshold": 1.0}
    code = {x: i for i, x in enumerate(names)}
    label = np.array([code[x] for x in got[target].to_pylist()])
    data = list(zip(
        [np.asarray(x.values) for x in got["ids"].combine_chunks()],
        [np.asarray(x.values) for x in got["shares"].combine_chunks()],
    ))
    order = np.random.default_rng(3).permutation(len(data))
    held, learn = order[: len(order) // 5], order[len(order) // 5 :]
    logits = train([data[i] for i in learn], label[learn], len(names))
    temperature, threshold = 1.0, 0.5
    if len(held):
        scores = np.array([data[i][1] @ logits[data[i][0]] if len(data[i][0]) else np.zeros(len(names)) for i in held])
        temperature, threshold = calibrate(scores, label[held])
    return {"names": names, "logits": logits, "temperature": temperature, "threshold": threshold}


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score and whether the score is above the rejection level.

    A null text or one without a letter is ``und`` with score 0. The score is the calibrated
    probability of the language. A repeated row is answered again; other columns are ignored.
    """
    names, temperature, threshold = model["names"], model["temperature"], model["threshold"]
    shared = docs.sparkSession.sparkContext.broadcast(model["logits"])  # BUCKETS x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                letters = np.asarray(pc.fill_null(part["letters"], False)) & bool(names)
                p = _softmax(row_averages(Words(part["text"]), shared.value) * temperature)
                best = p.argmax(1)
                score = np.where(letters, p.max(1), 0.0)
                lang = [names[k] if ok else "und" for k, ok in zip(best, letters)]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(lang, pa.string()), pa.array(score), pa.array(letters & (score >= threshold))],
                    ["doc_id", "lang_pred", "score", "accepted"],
                )

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), text.rlike(r"\p{L}").alias("letters"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double, accepted boolean")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(remainder("doc_id", 4) != 2))
    return identify(docs, model).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted"
    )
