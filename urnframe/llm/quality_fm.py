"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

The score of sparse features x is w0 + sum(w_i x_i) + the sum over all pairs of <v_i, v_j> x_i x_j.
The pair sum is half of the sum over factors of (sum v_if x_i)^2 - sum v_if^2 x_i^2: linear in the
number of features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urnframe.llm.calibration import platt
from urnframe.llm.sampling import remainder, sample_ids
from urnframe.llm.store import table
from urnframe.llm.text import U64, Words, raw, slices

BUCKETS = 1 << 15  # of words
BINS = 8  # of each statistic, by the quantiles of the sample
FACTORS = 8
SAMPLE = 2500  # training texts of each label at most
LABELS = 2
FOLDS = 3  # machines; each learns from all folds but its own, and scores are the mean of their logits
STATS = (
    "upper", "digits", "marks", "symbols", "blanks", "foreign", "word_bytes", "words", "lines", "line_words", "different",
    "repeated_lines", "marked_words", "n_chars", "no_n_chars",
)
FEATURES = BUCKETS + len(STATS) * BINS


def _share(hit: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Share of marked bytes in every row."""
    sums = np.concatenate([[0], np.cumsum(hit)])
    return (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(bounds[1:] - bounds[:-1], 1)


def statistics(texts: pa.Array, n_chars: pa.Array, words: Words) -> np.ndarray:
    """Structure of every text and its metadata, one column for each of ``STATS``."""
    data, bounds = raw(texts)
    rows = len(bounds) - 1
    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    digit = (data >= 48) & (data <= 57)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    mark = ~(letter | digit | blank)
    usual = np.isin(data, np.frombuffer(b".,;:'\"!?()-", np.uint8))
    # lines: their number, and the share of them that an earlier line of the text repeats
    start = np.flatnonzero(np.r_[True, data[:-1] == 10] if len(data) else np.zeros(0, bool))
    start = np.union1d(start, bounds[:-1][bounds[:-1] < bounds[1:]]).astype(np.int64)
    end = np.append(start[1:], len(data)).astype(np.int64)
    of = np.searchsorted(bounds, start, "right") - 1
    key = words.span(start, end) if len(start) else np.zeros(0, np.uint64)
    _, first = np.unique(np.stack([of.astype(np.uint64), key], 1), axis=0, return_index=True) if len(start) else (None, [])
    lines = np.bincount(of, minlength=rows)
    new_lines = np.bincount(of[first], minlength=rows)
    n = words.counts
    size = np.bincount(words.row, words.end - words.start, rows)
    marks_before = np.concatenate([[0], np.cumsum(mark)])
    marked = (marks_before[words.end] - marks_before[words.start]) * 2 >= words.end - words.start
    _, one = np.unique(np.stack([words.row.astype(np.uint64), words.key], 1), axis=0, return_index=True) if len(words.key) else (None, [])
    different = np.bincount(words.row[one], minlength=rows)
    some = np.maximum(n, 1)
    chars = np.asarray(pc.fill_null(n_chars, 0), np.float64)
    return np.stack(
        [
            _share(upper, bounds) / np.maximum(_share(letter, bounds), 1e-9), _share(digit, bounds), _share(mark, bounds),
            _share(mark & ~usual, bounds), _share(blank, bounds), _share(data >= 128, bounds), size / some, np.log1p(n),
            np.log1p(lines), n / np.maximum(lines, 1), different / some, 1 - new_lines / np.maximum(lines, 1),
            np.bincount(words.row, marked, rows) / some, np.log1p(np.maximum(chars, 0)),
            np.asarray(pc.is_null(n_chars), np.float64),
        ],
        1,
    )


def word_shares(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of every row's hashed words; a row's values have length 1."""
    rows = len(words.counts)
    code, count = np.unique(words.row * BUCKETS + (words.key % U64(BUCKETS)).astype(np.int64), return_counts=True)
    row, value = code // BUCKETS, np.log1p(count)
    norm = np.sqrt(np.bincount(row, value * value, rows))
    return row, code % BUCKETS, value / norm[row]


def _binned(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The feature number of each statistic's bin."""
    bins = np.stack([np.searchsorted(e, s, "right") for e, s in zip(edges, stats.T)], 1)
    return BUCKETS + np.arange(len(STATS)) * BINS + bins


class Machine:
    """Weights, factors and the pair sum in linear time."""

    def __init__(self, seed: int = 11):
        self.w0 = 0.0
        self.w = np.zeros(FEATURES)
        self.v = np.random.default_rng(seed).normal(scale=0.05, size=(FEATURES, FACTORS))

    def sums(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Logits, and the sums of factors that their gradient needs. Rows come in rising order."""
        linear = np.bincount(row, self.w[feature] * value, rows)
        vx = self.v[feature] * value[:, None]
        first = np.searchsorted(row, np.arange(rows))
        total = np.add.reduceat(vx, first, axis=0)
        squares = np.add.reduceat((vx * vx).sum(1), first)
        return self.w0 + linear + ((total * total).sum(1) - squares) / 2, total

    def train(self, data: list, label: np.ndarray, epochs: int = 12, least: int = 400, rate: float = 0.1, size: int = 20,
              decay: float = 1e-3) -> "Machine":
        """Adaptive gradient steps over minibatches, ``least`` at least, with decay of the touched features."""
        rng = np.random.default_rng(12)
        seen0, seen_w, seen_v = 1e-8, np.full(FEATURES, 1e-8), np.full((FEATURES, FACTORS), 1e-8)
        share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
        self.w0 = float(np.log(share / (1 - share)))
        for _ in range(max(epochs, -(-least * size // max(1, len(data))))):
            order = rng.permutation(len(data))
            for k in range(0, len(order), size):
                own = order[k : k + size]
                lengths = [len(data[i][0]) for i in own]
                row = np.repeat(np.arange(len(own)), lengths)
                feature = np.concatenate([data[i][0] for i in own])
                value = np.concatenate([data[i][1] for i in own]).astype(np.float64)
                z, total = self.sums(row, feature, value, len(own))
                g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label[own]) / len(own)
                used, at = np.unique(feature, return_inverse=True)
                gx = g[row] * value
                gw = np.bincount(at, gx, len(used)) + decay * self.w[used] / len(own)
                gv = np.zeros((len(used), FACTORS))
                np.add.at(gv, at, gx[:, None] * (total[row] - self.v[feature] * value[:, None]))
                gv += decay * self.v[used] / len(own)
                seen0 += g.sum() ** 2
                seen_w[used] += gw * gw
                seen_v[used] += gv * gv
                self.w0 -= rate * g.sum() / np.sqrt(seen0)
                self.w[used] -= rate * gw / np.sqrt(seen_w[used])
                self.v[used] -= rate * gv / np.sqrt(seen_v[used])
        return self


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training rows: hashed words and their values, and the statistics."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part["text"])
            stats = statistics(part["text"], part["n_chars"], words)
            row, feature, value = word_shares(words)
            cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
            lists = lambda x: [x[a:b] for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["quality"], pa.array(lists(feature.astype(np.int32)), pa.list_(pa.int32())),
                 pa.array(lists(value.astype(np.float32)), pa.list_(pa.float32())), pa.array(list(stats), pa.list_(pa.float64()))],
                ["doc_id", "quality", "ids", "shares", "stats"],
            )


def _plain(docs: DataFrame, *keep: str) -> DataFrame:
    n_chars = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.lit(None).cast("bigint")
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), n_chars.alias("n_chars"), *keep
    )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Learn ``labels.quality`` from at most ``sample`` texts of each label.

    ``FOLDS`` machines are each trained without one fold; a row's logit under the machine that did
    not see it sets the scale of the scores. The labels' shares among all labelled rows, not those
    of the sample, set its shift. A doc_id with both labels counts as 0. Without labelled rows every
    score is 0.5.
    """
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    picked = F.broadcast(sample_ids(known, "quality", sample, LABELS))
    got = (
        _plain(docs).join(picked, "doc_id")
        .mapInArrow(_rows, "doc_id bigint, quality int, ids array<int>, shares array<float>, stats array<double>")
        .toArrow()
    )
    y = got["quality"].to_numpy()
    if not len(y):
        return {"edges": np.zeros((len(STATS), BINS - 1)), "machines": [], "scale": (1.0, 0.0)}
    by_id = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    stats = np.array(got["stats"].to_pylist())[by_id]
    y = y[by_id].astype(np.float64)
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    ids, shares = ([np.asarray(x.values) for chunk in got[c].chunks for x in chunk] for c in ("ids", "shares"))
    bins = _binned(stats, edges)
    even = np.full(len(STATS), 1 / np.sqrt(len(STATS)))
    data = [(np.concatenate([ids[i], b]), np.concatenate([shares[i], even])) for i, b in zip(by_id, bins)]
    fold = np.empty(len(data), np.int64)
    for value in (0, 1):
        own = np.random.default_rng(14).permutation(np.flatnonzero(y == value))
        fold[own] = np.arange(len(own)) % FOLDS
    machines, z = [], np.zeros(len(data))
    for k in range(FOLDS):
        held = np.flatnonzero(fold == k)
        learn = np.flatnonzero(fold != k) if (fold != k).any() else held
        machines.append(Machine(11 + k).train([data[i] for i in learn], y[learn]))
        for i in held:
            row = np.zeros(len(data[i][0]), np.int64)
            z[i] = machines[k].sums(row, data[i][0], data[i][1].astype(np.float64), 1)[0][0]
    a, b = platt(z, y)
    total = dict(known.groupBy("quality").count().collect())
    if len(total) == 2:  # one of two labels may be thinned out in the sample
        b += np.log(total[1] / total[0]) - np.log(max(y.sum(), 1) / max((1 - y).sum(), 1))
    pa.default_memory_pool().release_unused()
    return {"edges": edges, "machines": machines, "scale": (a, float(b))}


def score_texts(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score, the calibrated probability of label 1, of every row.

    Words, structure and ``n_chars`` (null where the table has none) are the only inputs. A null or
    empty text has no words and empty statistics. Repeated rows are scored each; other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    even = 1 / np.sqrt(len(STATS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        a, b = model["scale"]
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part["text"])
                rows = part.num_rows
                stats = _binned(statistics(part["text"], part["n_chars"], words), model["edges"])
                row, feature, value = word_shares(words)
                row = np.concatenate([row, np.repeat(np.arange(rows), len(STATS))])
                order = np.argsort(row, kind="stable")
                feature = np.concatenate([feature, stats.ravel()])[order]
                value = np.concatenate([value, np.full(stats.size, even)])[order]
                z = [m.sums(row[order], feature, value, rows)[0] for m in model["machines"]]
                score = 1 / (1 + np.exp(-np.clip(a * np.mean(z, axis=0) + b, -500, 500))) if z else np.full(rows, 0.5)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(score)], ["doc_id", "score"])

    return _plain(docs).mapInArrow(run, "doc_id bigint, score double")


def op11_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = remainder("doc_id", 3) != 1
    return score_texts(docs, fit(docs.where(learn), labels.where(learn))).select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
