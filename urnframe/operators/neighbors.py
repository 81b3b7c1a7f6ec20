"""Exact k nearest neighbours without comparing all pairs."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urnframe.operators.features import FEATURE_ORDER
from urnframe.plans.joins import spread
from urnframe.session import checkpoint_frame

LEAF = 4096  # training vectors of one leaf, about
SAMPLED = 1 << 17  # vectors at most whose values choose the cuts between leaves
ASKED = 8192  # wanted vectors that one group searches a leaf for, about
BLOCK = 1 << 20  # distances that are held at once
CLOSE = 1e-8  # distances are rounded to nine decimals: nearer ones may tie


class Forest(NamedTuple):
    """One tree of cuts per lottery. Cuts only say where a vector lives; no vector is left out for them."""

    roots: dict[int, int]
    axis: np.ndarray  # -1 in a leaf
    cut: np.ndarray  # up to and with it: left
    down: np.ndarray  # left and right child
    low: np.ndarray  # the box of each node
    high: np.ndarray
    leaves: dict[int, np.ndarray]

    def place(self, lottery: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The leaf of every vector; -1 in a lottery of one leaf."""
        known, where = np.unique(lottery, return_inverse=True)
        at = np.array([self.roots.get(int(n), -1) for n in known], np.int64)[where]
        open_rows = np.flatnonzero(at >= 0)
        while len(open_rows := open_rows[self.axis[at[open_rows]] >= 0]):
            node = at[open_rows]
            right = x[open_rows, self.axis[node]] > self.cut[node]
            at[open_rows] = self.down[node, right.astype(np.int64)]
        return at

    def visits(self, lottery: int, own: int, x: np.ndarray, within: np.ndarray) -> list[np.ndarray]:
        """Per vector the other leaves of its lottery that reach into its distance."""
        leaves = self.leaves.get(lottery, np.zeros(0, np.int64))
        leaves = leaves[leaves != own]
        if len(x) and len(leaves):
            apart = np.maximum(np.maximum(self.low[leaves] - x.max(0), x.min(0) - self.high[leaves]), 0)
            leaves = leaves[(apart**2).sum(1) <= within.max() + 1e-6]
        out = []
        step = max(1, BLOCK // max(1, len(leaves) * x.shape[1]))
        for i in range(0, len(x), step):
            rows = x[i : i + step, None]
            apart = np.maximum(np.maximum(self.low[leaves] - rows, rows - self.high[leaves]), 0)
            near = (apart**2).sum(2) <= within[i : i + step, None] + 1e-6
            out += [leaves[row] for row in near]
        return out


def _forest(base: DataFrame, leaf: int) -> Forest:
    """Cuts at medians of a sample of the vectors, until a leaf stands for about ``leaf`` of them."""
    n = base.count()
    every = -(-n // SAMPLED) if n else 1
    some = base.select("lottery_id", *FEATURE_ORDER).where(F.pmod(F.xxhash64(*FEATURE_ORDER), F.lit(every)) == 0).toArrow()
    values = np.stack([np.asarray(some[c], np.float64) for c in FEATURE_ORDER], 1)
    lottery = np.asarray(some["lottery_id"], np.int64)
    axis, cut, down, low, high = [], [], [], [], []
    roots, leaves = {}, {}

    def grow(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, ends: list[int]) -> int:
        node = len(axis)
        axis.append(-1), cut.append(0.0), down.append([-1, -1]), low.append(lo), high.append(hi)
        spans = np.ptp(np.quantile(x, [0.05, 0.95], axis=0), axis=0)
        spans = np.where(np.ptp(x, axis=0) > 0, spans + 1e-9, 0)
        if len(x) * every <= leaf or len(x) < 4 or not spans.any():
            ends.append(node)
            return node
        on = int(spans.argmax())
        at = np.median(x[:, on])
        if at >= x[:, on].max():
            at = x[x[:, on] < at, on].max()
        left = x[:, on] <= at
        axis[node], cut[node] = on, at
        lower, upper = hi.copy(), lo.copy()
        lower[on] = upper[on] = at
        down[node] = [grow(x[left], lo, lower, ends), grow(x[~left], upper, hi, ends)]
        return node

    for number in np.unique(lottery):
        ends: list[int] = []
        side = np.full(len(FEATURE_ORDER), np.inf)
        roots[int(number)] = grow(values[lottery == number], -side, side, ends)
        leaves[int(number)] = np.array(ends, np.int64)
    width = len(FEATURE_ORDER)
    return Forest(
        roots, np.array(axis, np.int64), np.array(cut, np.float64), np.array(down, np.int64).reshape(-1, 2),
        np.array(low, np.float64).reshape(-1, width), np.array(high, np.float64).reshape(-1, width), leaves,
    )


def _placed(df: DataFrame, forest: Forest) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.asarray(batch[c], np.float64) for c in FEATURE_ORDER], 1)
            yield batch.append_column("leaf", pa.array(forest.place(np.asarray(batch["lottery_id"], np.int64), x)))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, leaf bigint")


def _near(x: np.ndarray, within: np.ndarray, y: np.ndarray, draws: np.ndarray, ends: np.ndarray, k: int):
    """The ``k`` nearest draws of each vector of ``x``, with all that may tie with the last one.

    ``y`` has vectors whose draws are ``draws`` up to their ``ends``. Products of matrices only choose
    the vectors whose distances are then added up feature by feature.
    """
    middle = y.mean(0)
    xs, ys = x - middle, y - middle
    xn, yn = (xs**2).sum(1), (ys**2).sum(1)
    begins = np.concatenate([[0], ends[:-1]])
    step = max(1, BLOCK // len(y))
    for i in range(0, len(x), step):
        rows = slice(i, i + step)
        rough = xn[rows, None] + yn - 2 * (xs[rows] @ ys.T)
        slack = CLOSE + 1e-12 * (xn[rows] + yn.max())
        limit = within[rows] if len(y) < k else np.minimum(within[rows], np.partition(rough, k - 1, 1)[:, k - 1])
        of, at = np.nonzero(rough <= (limit + 2 * slack)[:, None])
        d2 = np.zeros(len(of))
        for f in range(x.shape[1]):  # in this order, as one row's sum would be
            gap = x[i + of, f] - y[at, f]
            d2 += gap * gap
        size = ends[at] - begins[at]
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(first, size) + np.repeat(begins[at], size)
        of, d2, near = np.repeat(of, size), np.repeat(d2, size), draws[place]
        order = np.lexsort((near, d2, of))
        of, d2, near = of[order], d2[order], near[order]
        same = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (d2[1:] != d2[:-1])])) if len(of) else np.zeros(0, int)
        rank = np.arange(len(of)) - np.repeat(same, np.diff(np.append(same, len(of))))
        kept = rank < k  # of one distance only the first draws can be neighbours
        of, d2, near = of[kept], d2[kept], near[kept]
        counts = np.bincount(of, minlength=len(x[rows]))
        start = np.cumsum(counts) - counts
        last = np.full(len(counts), np.inf)
        last[counts >= k] = d2[start[counts >= k] + k - 1]
        kept = d2 <= np.minimum(last, within[rows])[of] + CLOSE
        counts = np.bincount(of[kept], minlength=len(counts))
        yield near[kept], d2[kept], counts, last


def _dealt(df: DataFrame, hot: dict[tuple[int, int], int], copied: bool) -> DataFrame:
    """Add ``part``: rows of a hot leaf are dealt to its parts, or copied to each of them."""
    if not hot:
        return df.withColumn("part", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            homes = zip(batch["lottery_id"].to_pylist(), batch["leaf"].to_pylist())
            parts = np.array([hot.get(home, 1) for home in homes], np.int64)
            if copied:
                rows = np.repeat(np.arange(len(parts)), parts)
                part = np.arange(len(rows)) - np.repeat(np.cumsum(parts) - parts, parts)
                batch = batch.take(pa.array(rows))
            else:
                part = np.asarray(batch["deal"], np.int64) % parts
            yield batch.append_column("part", pa.array(part.astype(np.int32)))

    dealt = df if copied else df.withColumn("deal", F.shiftright(F.xxhash64("shape"), 1).bitwiseAND(F.lit(0xFFFFFF)))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields)
    return dealt.mapInArrow(run, f"{fields}, part int")


def _searched(asked: DataFrame, base: DataFrame, k: int, forest: Forest, each: int, ahead: bool) -> DataFrame:
    """Candidates of every asked vector in its leaf; with ``ahead`` also the other leaves to search.

    A leaf that more than ``each`` vectors ask for is copied to several groups, each with a part of them.
    """
    home = ["lottery_id", "leaf"]
    loads = asked.groupBy(*home).agg(F.count("*").alias("n")).where(F.col("n") > each).collect()
    hot = {(r["lottery_id"], r["leaf"]): -(-r["n"] // each) for r in loads}
    keys = [*home, "part"]
    own, held = spread(_dealt(asked, hot, False), *keys), spread(_dealt(base, hot, True), *keys)

    def run(asking: pa.Table, there: pa.Table) -> pa.Table:
        x, y = (np.stack([np.asarray(t[c], np.float64) for c in FEATURE_ORDER], 1) for t in (asking, there))
        within = np.asarray(asking["within"], np.float64)
        if not len(x):
            parts = []
        elif not len(y):
            nothing = np.zeros(0, np.int64)
            parts = [(nothing, nothing.astype(np.float64), np.zeros(len(x), np.int64), np.full(len(x), np.inf))]
        else:
            listed = there["draws"].combine_chunks()
            ends = np.cumsum(np.asarray(listed.value_lengths(), np.int64))
            parts = list(_near(x, within, y, np.asarray(listed.flatten(), np.int64), ends, k))
        near, d2, counts, last = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(4))
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        out = asking.select([*("lottery_id", "shape"), *FEATURE_ORDER])
        out = out.append_column("within", pa.array(last, pa.float64()))
        out = out.append_column("draws", pa.ListArray.from_arrays(ends, pa.array(near.astype(np.int64))))
        out = out.append_column("d2", pa.ListArray.from_arrays(ends, pa.array(d2, pa.float64())))
        visits = [[] for _ in range(len(x))]
        if ahead and len(x):
            visits = forest.visits(asking["lottery_id"][0].as_py(), asking["leaf"][0].as_py(), x, last)
        return out.append_column("visits", pa.array(visits, pa.list_(pa.int64())))

    types = dict(asked.dtypes)
    fields = [f"{c} {types[c]}" for c in ("lottery_id", "shape", *FEATURE_ORDER, "within")]
    schema = ", ".join([*fields, "draws array<bigint>", "d2 array<double>", "visits array<bigint>"])
    return own.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(run, schema)


def nearest(train: DataFrame, wanted: DataFrame, k: int = 5, leaf: int = LEAF, each: int = ASKED) -> DataFrame:
    """The ``k`` nearest training draws of every wanted draw, Euclidean on the feature columns.

    Equal vectors are compared once: of identical training vectors only the first ``k`` draws
    can be neighbours, and identical wanted vectors share one search. Vectors live in the leaves of
    trees of about ``leaf`` training vectors. A vector is searched for in its own leaf; the k-th distance
    there says which other leaves can hold a nearer draw, and those alone are searched, too. Leaves
    meet their vectors in groups, which return the nearest draws and never their pairs. No table of draws is
    broadcast: packed well, it would count as small and fill the driver. Ties go to the lower draw number.
    """
    vector = ["lottery_id", *FEATURE_ORDER]
    order = W.partitionBy(*vector).orderBy("draw_number")
    base = (
        train.select(*vector, "draw_number")
        .dropna()
        .withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= k)
        .groupBy(*vector)
        .agg(F.sort_array(F.collect_list("draw_number")).alias("draws"))
    )
    base = checkpoint_frame(base)
    forest = _forest(base, leaf)
    held = _placed(base, forest)
    shapes = wanted.dropna(subset=vector).groupBy(*vector).agg(F.min("draw_number").alias("shape"))
    first = checkpoint_frame(_placed(shapes.withColumn("within", F.lit(float("inf"))), forest))
    first = checkpoint_frame(_searched(first, held, k, forest, each, True))
    further = first.select("lottery_id", "shape", *FEATURE_ORDER, "within", F.explode("visits").alias("leaf"))
    every = first.unionByName(_searched(further, held, k, forest, each, False))
    pairs = every.select("lottery_id", "shape", F.explode(F.arrays_zip("draws", "d2")).alias("c")).select(
        "lottery_id", "shape", F.col("c.draws").alias("neighbor"), F.round("c.d2", 9).alias("d2")
    )
    best = W.partitionBy("lottery_id", "shape").orderBy("d2", "neighbor")
    top = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    named = wanted.join(shapes.hint("merge"), vector).select("lottery_id", "draw_number", "shape")
    return named.join(top.hint("merge"), ["lottery_id", "shape"]).select(
        "lottery_id", "draw_number", F.col("rank").cast("long").alias("rank"), "neighbor", "d2"
    )


def knn_votes(neighbors: DataFrame, targets: DataFrame, k: int = 5) -> DataFrame:
    """Share of the neighbours whose next draw holds a number, and the majority label."""
    labels = targets.where(F.col("label") == 1).select(
        "lottery_id", F.col("draw_number").alias("neighbor"), "number"
    )
    votes = (
        neighbors.join(labels.hint("merge"), ["lottery_id", "neighbor"])
        .groupBy("lottery_id", "draw_number", "number")
        .agg((F.count("*") / k).alias("score"))
    )
    return votes.withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
