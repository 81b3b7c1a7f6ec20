"""Nearest neighbours by an inverted multi-index.

Vector halves are quantised separately; a vector's cell is the pair of its halves' centroids. A
query visits cells by falling sum of the two half products, off a heap, until its budget of
entries is met, and the entries of these cells are ranked by the exact product. The number of
centroids grows with the table. The budget is measured: for some queries all true neighbours are
searched, and the budget is what reaches the wanted share of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urnframe.llm.store import stored, table

SAMPLE = 20_000  # vectors that the centroids are fitted on, at most
MOST = 256  # centroids of a half at most
RECALL = 0.95  # share of the true neighbours that the measured budget reaches
ASKED = 64  # queries on which the budget is measured
BLOCK = 4096  # entries that are ranked together


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector as doubles; vectors that are null, zero or not finite take no part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return (
        vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & some)
    )


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of ``x`` by Lloyd's rounds from ``k`` of its rows."""
    rng = np.random.default_rng(2)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        for j in range(len(c)):
            mine = near == j
            if mine.any():
                c[j] = x[mine].mean(0)
    return c


def fit(vectors: DataFrame, centroids: int, sample: int = SAMPLE) -> list[np.ndarray]:
    """Centroids of the two halves, from at most ``sample`` vectors, the first by a hash of the id."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()["v"].to_pylist()
    if not rows:
        return []
    x = np.array(rows)
    half = x.shape[1] // 2
    return [kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids)]


def _dense(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(values.flatten(), np.float64)
    return flat.reshape(len(values), -1) if len(values) else np.zeros((0, 0))


def with_cells(vectors: DataFrame, centroids: list[np.ndarray]) -> DataFrame:
    """Adds each vector's cell, the pair of its nearest centroids as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _dense(batch["v"])
            half = centroids[0].shape[1]
            a, b = (
                ((c * c).sum(1) - 2 * part @ c.T).argmin(1)
                for c, part in zip(centroids, (x[:, :half], x[:, half:]))
            )
            cell = a * len(centroids[1]) + b
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["v"], pa.array(cell.astype(np.int64))], ["vec_id", "v", "cell"]
            )

    return vectors.mapInArrow(run, "vec_id bigint, v array<double>, cell bigint")


def visit(first: np.ndarray, second: np.ndarray, counts: np.ndarray, budget: int) -> list[int]:
    """Cells by falling ``first[i] + second[j]``, off a heap, until they hold ``budget`` entries.

    The multi-sequence rule: a pair enters the heap when its neighbours with better halves left it.
    """
    order_a, order_b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    a, b = first[order_a], second[order_b]
    heap, waiting, found, cells = [(-(a[0] + b[0]), 0, 0)], {(0, 0)}, 0, []
    passed = np.zeros((len(a) + 1, len(b) + 1), bool)
    passed[-1, :] = passed[:, -1] = True
    while heap and found < budget:
        _, i, j = heapq.heappop(heap)
        passed[i, j] = True
        cell = int(order_a[i] * len(b) + order_b[j])
        if counts[cell]:
            cells.append(cell)
            found += int(counts[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and passed[x - 1, y] and passed[x, y - 1] and (x, y) not in waiting:
                waiting.add((x, y))
                heapq.heappush(heap, (-(a[x] + b[y]), x, y))
    return cells


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def buckets_of(sizes: np.ndarray, row: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each cell, and parts of each bucket: neighbours of a row of cells until ``block`` entries.

    A larger cell is a bucket of its own and is ranked in parts.
    """
    bucket, parts, held = np.zeros(len(sizes), np.int64), [], block
    for cell, size in enumerate(sizes.tolist()):
        if cell % row == 0 or held + size > block:
            parts.append(max(1, -(-size // block)))
            held = 0
        bucket[cell] = len(parts) - 1
        held += size
    return bucket, np.array(parts, np.int64)


def measured_budget(
    entered: DataFrame, asked: DataFrame, books: list[np.ndarray], sizes: np.ndarray, k: int, recall: float = RECALL, some: int = ASKED
) -> float:
    """Share of the entries that a query has to visit to reach ``recall`` of its ``k`` nearest different vectors.

    Measured on ``some`` queries, the first by a hash of the id: every task ranks its entries for all
    of them and returns ``k + 1``.
    """
    from pyspark.sql import Window

    picked = asked.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(some).toArrow()
    q, of = _dense(picked["v"]), np.asarray(picked["vec_id"])
    if not len(q):
        return 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = q @ _dense(batch["v"]).T
            top = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(q)), top.shape[1])), pa.array(np.take_along_axis(s, top, 1).ravel()),
                 batch["cell"].take(pa.array(top.ravel())), batch["vec_id"].take(pa.array(top.ravel()))],
                ["query", "score", "cell", "vec_id"],
            )

    near = entered.select("vec_id", "v", "cell").mapInArrow(run, "query bigint, score double, cell bigint, vec_id bigint")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    rows = near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).collect()  # some * (k + 1)
    half, needed = books[0].shape[1], []
    left, right = q[:, :half] @ books[0].T, q[:, half:] @ books[1].T
    for i in range(len(q)):
        order = np.argsort(-(left[i][:, None] + right[i][None, :]).ravel(), kind="stable")
        before = np.empty(len(sizes), np.int64)
        before[order] = np.cumsum(sizes[order]) - sizes[order]
        needed += [before[r["cell"]] for r in rows if r["query"] == i and r["vec_id"] != of[i]][:k]
    if not needed:
        return 1.0
    return float((np.quantile(needed, recall, method="higher") + 1) / max(1, sizes.sum()))


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, budget: float | None = None, centroids: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """The ``k`` nearest entries found for each query, by inner product in doubles.

    ``vectors`` and ``queries`` have ``vec_id`` and ``embedding``. A query is no answer to itself
    (same vec_id). Equal products go by vec_id. Equal vectors are entered once, with their ``k+1``
    smallest ids: further ones cannot be among the answers, so no group of copies grows a cell.
    Neighbouring cells form buckets of about ``block`` entries; a larger cell is ranked in parts whose
    best answers are merged. ``budget`` is the share of all entries that a query visits before it
    stops, at least ``k + 1`` different vectors; it is measured where it is not given.
    ``centroids`` of a half are twice the fourth root of the number of vectors where not given. An empty table,
    or vectors of no use, give no rows. Vectors of another length than the most common one (ties: the
    longest) take no part.
    """
    spark = vectors.sparkSession
    entries = clean(vectors)
    # one number per vector length
    lengths = entries.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    entries = entries.where(F.size("v") == (lengths["d"] if lengths else 0))
    ranked = entries.select("v", "vec_id").distinct()
    from pyspark.sql import Window

    hashed = ranked.withColumn("h", F.xxhash64("v")).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(32)))
    few = Window.partitionBy("h", "v", "salt").orderBy("vec_id")
    first = Window.partitionBy("h", "v").orderBy("vec_id")
    kept = hashed.withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
    kept = kept.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    classes = kept.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = classes.select(F.col("ids")[0].alias("vec_id"), "v", "ids")
    out = "query_id bigint, rank int, vec_id bigint, score double"
    count = lengths["count"] if lengths else 0
    books = fit(entries, centroids or min(MOST, max(4, round(2 * count**0.25))))
    if not books:
        return spark.createDataFrame([], out)
    row, cells = len(books[1]), len(books[0]) * len(books[1])
    entered = stored(with_cells(classes.select("vec_id", "v"), books).join(classes.select("vec_id", "ids"), "vec_id"))
    sizes = np.zeros(cells, np.int64)  # one number per cell
    for r in entered.groupBy("cell").count().toLocalIterator():
        sizes[r["cell"]] = r["count"]
    asked = clean(queries).where(F.size("v") == lengths["d"]).select("vec_id", "v").distinct()
    share = measured_budget(entered, asked, books, sizes, k) if budget is None else budget
    goal = max(k + 1, int(np.ceil(share * sizes.sum())))
    bucket, parts = buckets_of(sizes, row, block)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each bucket part that a query visits, with the visited cells."""
        half = books[0].shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _dense(batch["v"])
            left, right = x[:, :half] @ books[0].T, x[:, half:] @ books[1].T
            for i in range(len(x)):
                seen = np.sort(np.array(visit(left[i], right[i], sizes, goal), np.int64))
                own, at = np.unique(bucket[seen], return_index=True)
                lists = np.split(seen, at[1:])
                each = parts[own]
                of = np.repeat(np.arange(len(own)), each)
                part = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
                again = pa.array(np.full(len(of), i))
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"].take(again), batch["v"].take(again), pa.array(own[of]), pa.array(part),
                     pa.array([lists[j] for j in of], pa.list_(pa.int64()))],
                    ["vec_id", "v", "bucket", "part", "cells"],
                )

    def rank(key: tuple, asks: pa.Table, have: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                         "score": pa.array([], pa.float64())})
        if not asks.num_rows or not have.num_rows:
            return none
        y = _dense(have["v"])
        lists = have["ids"].combine_chunks()
        ids = np.asarray(lists.flatten())
        lengths = np.asarray(pc.list_value_length(lists))
        begins = np.cumsum(lengths) - lengths
        lowest = np.asarray(have["vec_id"])
        here, cell = np.unique(np.asarray(have["cell"]), return_inverse=True)
        result = []
        for at in range(0, asks.num_rows, 256):
            part = asks.slice(at, 256)
            q = _dense(part["v"])
            rough = q @ y.T
            for r, (query, cells) in enumerate(zip(np.asarray(part["vec_id"]), part["cells"].to_pylist())):
                top = np.flatnonzero(np.isin(here, cells)[cell])
                if not len(top):
                    continue
                near = rough[r][top]
                if len(top) > k + 9:
                    best = near[np.argpartition(-near, k + 8)[: k + 9]]
                    top = top[near >= best.min() - 1e-9 * (1 + np.abs(best).max())]
                # one product at a time in a fixed order, so that equal vectors get equal scores
                s = (q[r] * y[top]).cumsum(1)[:, -1]
                best = _best(s, lowest[top], k + 1)
                top, s = top[best], s[best]
                cand = np.concatenate([ids[begins[t] : begins[t] + lengths[t]] for t in top])
                score = np.repeat(s, lengths[top])
                other = cand != query
                cand, score = cand[other], score[other]
                best = _best(score, cand, k)
                result.append((np.full(len(best), query), cand[best], score[best]))
        if not result:
            return none
        q, v, s = (np.concatenate(x) for x in zip(*result))
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s)})

    routed = asked.mapInArrow(route, "vec_id bigint, v array<double>, bucket bigint, part bigint, cells array<bigint>")
    places = list(zip(range(cells), bucket.tolist(), parts[bucket].tolist()))  # MOST * MOST at most
    placed = F.broadcast(spark.createDataFrame(places, "cell bigint, bucket bigint, pieces bigint"))
    dealt = entered.join(placed, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("pieces")))
    found = (
        routed.groupBy("bucket", "part")
        .cogroup(dealt.select("vec_id", "v", "ids", "cell", "bucket", "part").groupBy("bucket", "part"))
        .applyInArrow(rank, "query_id bigint, vec_id bigint, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
