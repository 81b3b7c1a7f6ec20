"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance.

A test item with an error budget of k edits is cut into k+1 pieces; a passage within the budget
holds one of them unchanged. Exact piece hits are found by one automaton over all pieces, and
each hit's surroundings are checked with Myers' bit-parallel distance (1999).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urnframe.llm.store import numbered, table
from urnframe.llm.text import slices

ERRORS = 0.05  # edits a character of the item
LEAST = 1  # items of fewer characters, after folding, are not searched: only empty ones
WHOLE_WORDS = 20  # items of fewer characters, without an error budget, count between word edges only
BLOCK = 8_000_000  # characters of items that one automaton holds

HITS = "doc_id bigint, item_id bigint, distance int, start bigint, end bigint"


def fold(text: str | None) -> str:
    """Lower case, runs of white space as one space: the form in which texts are compared."""
    return " ".join((text or "").lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length, with their places."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(masks: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """The best distance of the pattern to a part of ``text``, and where the part ends.

    ``masks`` has each character's places in the pattern as bits. The first of equal ends wins;
    None if the distance is above ``most``.
    """
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (~(xh | plus) & full)
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full  # a match may begin anywhere: no 1 enters
        mh = (mh << 1) & full
        plus = mh | (~(xv | ph) & full)
        minus = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, i + 1)
    return best


def masks_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


def between_edges(text: str, start: int, end: int) -> bool:
    """No word of ``text`` goes on across the start or the end of the passage."""
    inside = lambda at: 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()
    return not inside(start) and not inside(end)


class Finder:
    """The automaton over the pieces of some items, and the check of its hits."""

    def __init__(self, items: list[tuple[int, str]], errors: float):
        import ahocorasick

        self.items, self.trie, where = items, ahocorasick.Automaton(), defaultdict(list)
        for n, (_, text) in enumerate(items):
            for at, piece in pieces(text, int(errors * len(text))):
                where[piece].append((n, at))
        for piece, uses in where.items():
            self.trie.add_word(piece, (len(piece), uses))
        if where:
            self.trie.make_automaton()
        self.errors = errors
        self.masks = [(masks_of(t), masks_of(t[::-1])) for _, t in items]

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """The best passage of every item within its budget: item, distance, start and end."""
        if not len(self.trie):
            return []
        spans: dict[int, list[list[int]]] = defaultdict(list)
        whole: dict[int, int] = {}
        for last, (length, uses) in self.trie.iter(text):
            for n, at in uses:
                size = len(self.items[n][1])
                k = int(self.errors * size)
                if not k and size < WHOLE_WORDS:
                    if n not in whole and between_edges(text, last - length + 1, last + 1):
                        whole[n] = last - length + 1
                    continue
                a, b = last - length + 1 - at - k, last - length + 1 - at + size + k
                mine = spans[n]
                if mine and a <= mine[-1][1] and a >= mine[-1][0]:
                    mine[-1][1] = max(mine[-1][1], b)
                else:
                    mine.append([a, b])
        found = [(self.items[n][0], 0, at, at + len(self.items[n][1])) for n, at in sorted(whole.items())]
        for n, windows in sorted(spans.items()):
            item_id, item = self.items[n]
            k, best = int(self.errors * len(item)), None
            for a, b in sorted(windows):
                a = max(a, 0)
                got = myers(self.masks[n][0], len(item), text[a:b], k)
                if got and (best is None or got[0] < best[0]):
                    end = a + got[1]
                    low = max(a, end - len(item) - k)
                    back = myers(self.masks[n][1], len(item), text[low:end][::-1], got[0])
                    best = (got[0], end - (back[1] if back else len(item)), end)
            if best:
                found.append((item_id, *best))
        return found


def contaminations(docs: DataFrame, items: DataFrame, errors: float = ERRORS, block: int = BLOCK) -> DataFrame:
    """Passages of ``docs`` within ``errors`` edits a character of an item: one row for each document
    row and item, with the best distance and the first such passage in the folded text.

    Items are matched in blocks of about ``block`` characters; each block is one pass over the
    documents, so what a task holds is bounded while the items may grow. Items with a null id or
    text, or empty when folded, are not searched; a null text holds nothing. An item shorter than
    ``WHOLE_WORDS`` without an error budget is found as it is, where no word goes on across its ends.
    Repeated items are matched once, repeated documents once each.
    """
    spark = docs.sparkSession
    wanted = (
        items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
        .select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
        .distinct()
    )
    total = wanted.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("text").isNotNull())
    out = None
    for n in range(blocks):
        own = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n)
        texts = [(r["item_id"], fold(r["text"])) for r in own.orderBy("item_id", "text").collect()]
        shared = spark.sparkContext.broadcast([x for x in texts if len(x[1]) >= LEAST])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = Finder(shared.value, errors)
            for batch in batches:
                for part in slices(batch, "text"):
                    found = [
                        (doc_id, *hit)
                        for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist())
                        for hit in finder.find(fold(text))
                    ]
                    names = ["doc_id", "item_id", "distance", "start", "end"]
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                    columns = list(zip(*found)) if found else [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        hits = rows.mapInArrow(run, HITS)
        out = hits if out is None else out.unionByName(hits)
    return out


def without_contamination(docs: DataFrame, items: DataFrame, errors: float = ERRORS) -> DataFrame:
    """The rows of ``docs`` that hold no item. Rows with a null id are judged by all such rows.

    Columns may have any name.
    """
    hits = contaminations(docs, items, errors).select("doc_id").distinct()
    rows, new = numbered(docs)
    clean = rows.join(hits, F.col(new["doc_id"]).cast("bigint").eqNullSafe(F.col("doc_id")), "left_anti")
    return clean.toDF(*docs.columns)


def op6_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
