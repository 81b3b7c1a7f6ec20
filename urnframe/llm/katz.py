"""A Katz backoff language model of words, counted and evaluated in blocks of documents.

A block holds some documents as numbers of its own words. It sends its different n-grams, hashed,
to the cells of their hashes; a cell adds up the training counts of all blocks and answers each
block in the order of its question. With these counts a block scores what was seen in training,
and passes on the histories that it has to back off from; their weights come from one aggregation
over all blocks. What is sent is one entry per block and different n-gram, so a very common word
is no larger than a rare one.

Probabilities. Counts r up to K are discounted by Good-Turing: r* = (r+1) n(r+1)/n(r), in Katz's
form that leaves counts above K whole; these lose LARGE of a count, so that every history keeps
some mass for what it was not seen with. Where the estimate is not inside (0, 1), as with few
rows, r-1/2 stands for r*. Unseen words share the mass that the discounts of single words leave.
A history's backoff weight is (1 - seen mass) / (1 - mass of the same words one order below), so
that probabilities of all words and the unknown word sum to one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urnframe.llm.sampling import remainder
from urnframe.llm.signature_join import runs_of
from urnframe.llm.store import dropped, parts_for, stored, table
from urnframe.llm.text import U64, Words, mix, slices

K = 5
LARGE = 0.01
BLOCK = 6 << 20  # bytes of text of a block
CELL = 6 << 20  # bytes of input files whose n-grams make one cell
END = U64(0x9D5F3A1B27C4E681)  # stands for the end of a text
START = U64(0x71B6C0E5A94D2F83)  # stands for what comes before its first word
_FLAG = np.uint32(1 << 31)

BLOCKS = "block bigint, doc_ids binary, nulls binary, train binary, lengths binary, vocabulary binary, tokens binary"
ASKED = "ngram int, cell int, block bigint, keys binary, counts binary"


def blocks(docs: DataFrame) -> DataFrame:
    """Documents in blocks; a document is its words and the end, as numbers of the block's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                words = Words(part["text"])
                ends = np.cumsum(words.counts)
                keys = np.insert(words.key, ends, END)
                vocabulary, tokens, uses = np.unique(keys, return_inverse=True, return_counts=True)
                order = np.argsort(-uses, kind="stable")  # common words get small numbers
                place = np.empty(len(order), np.uint32)
                place[order] = np.arange(len(order), dtype=np.uint32)
                tokens = place[tokens.ravel()]
                if len(order) <= 65536:
                    tokens = tokens.astype(np.uint16)
                values = [
                    np.asarray(pc.fill_null(part["doc_id"], 0), np.int64), np.asarray(pc.is_null(part["doc_id"])),
                    np.asarray(part["train"]), (words.counts + 1).astype(np.int32), vocabulary[order], tokens,
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), *(pa.array([v.tobytes()], pa.binary()) for v in values)],
                    ["block", "doc_ids", "nulls", "train", "lengths", "vocabulary", "tokens"],
                )
                number += 1

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("train")
    )
    return rows.mapInArrow(run, BLOCKS)


class Block:
    """A block's arrays, its different single words and pairs, and where their answers are."""

    def __init__(self, row: dict, cells: int):
        self.vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        size = len(self.vocabulary)
        wide = np.uint16 if size <= 65536 else np.uint32
        self.tokens = np.frombuffer(row["tokens"], wide).astype(np.int64)
        self.lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
        self.train = np.frombuffer(row["train"], bool)
        self.doc_ids = np.frombuffer(row["doc_ids"], np.int64)
        self.nulls = np.frombuffer(row["nulls"], bool)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.start = size  # the number that stands for the start
        before = np.r_[self.start, self.tokens[:-1]]
        before[np.cumsum(self.lengths) - self.lengths] = self.start
        self.before = before
        own = self.train[self.doc]
        self.grams = []  # per order: hashes, training uses, other uses; positions' gram numbers
        learnt = np.bincount(self.tokens, own, size)
        self.grams.append((self.vocabulary, learnt, np.bincount(self.tokens, ~own, size)))
        pair, which = np.unique(before * (size + 1) + self.tokens, return_inverse=True)
        self.which = which.ravel()
        self.pair = pair // (size + 1), pair % (size + 1)
        names = np.r_[self.vocabulary, START]
        hashed = mix(names[self.pair[0]] * U64(0xC2B2AE3D27D4EB4F) + self.vocabulary[self.pair[1]])
        self.grams.append((hashed, np.bincount(self.which, own, len(pair)), np.bincount(self.which, ~own, len(pair))))
        self.orders = []
        for keys, _, _ in self.grams:
            keys = keys >> U64(8)  # 56 bits
            cell = (keys % U64(cells)).astype(np.int64)
            order = np.lexsort((keys, cell))
            at = np.flatnonzero(np.r_[True, cell[order][1:] != cell[order][:-1], True]) if len(order) else np.zeros(1, int)
            self.orders.append((order, cell[order], keys[order], at))


def _packed(keys: np.ndarray) -> bytes:
    """Rising 56-bit keys as their differences, byte plane by byte plane."""
    step = np.diff(keys, prepend=U64(0))
    wide = 5 if not len(step) or int(step.max()) < 1 << 40 else 8
    return bytes([wide]) + np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def _unpacked(body: bytes) -> np.ndarray:
    wide = body[0]
    planes = np.frombuffer(body, np.uint8, offset=1).reshape(wide, -1)
    step = np.zeros((planes.shape[1], 8), np.uint8)
    step[:, :wide] = planes.T
    return np.cumsum(step.view(np.uint64).ravel(), dtype=np.uint64)


def _questions(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in batch.schema.names}
                block = Block(row, cells)
                for n, ((order, cell, keys, at), (_, learnt, other)) in enumerate(zip(block.orders, block.grams), 1):
                    if len(at) < 2:
                        continue
                    counts = np.stack([learnt[order], other[order] > 0], 0).astype(np.uint32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at) - 1, n, np.int32)), pa.array(cell[at[:-1]].astype(np.int32)),
                         pa.array(np.full(len(at) - 1, row["block"])),
                         pa.array([_packed(keys[a:b]) for a, b in zip(at, at[1:])], pa.binary()),
                         pa.array([counts[:, a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())],
                        ["ngram", "cell", "block", "keys", "counts"],
                    )

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training counts of all blocks, for every block in the order of its question.

    Highest bit of a single word's answer: texts outside training have it too. Of a pair's answer:
    this block, of all that learnt the pair, accounts for it. A row of block -1 has the number of
    n-grams by count (1 to K+1), of all n-grams and of all uses.
    """
    for part in runs_of(batches, "place"):
        n = part["ngram"][0].as_py()
        keys = [_unpacked(x) for x in part["keys"].to_pylist()]
        sizes = [len(k) for k in keys]
        counts = np.concatenate([np.frombuffer(c, np.uint32).reshape(2, -1) for c in part["counts"].to_pylist()], 1)
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        run = np.cumsum(np.r_[False, key[order][1:] != key[order][:-1]])
        learnt = counts[0][order].astype(np.int64)
        total = np.add.reduceat(learnt, at)
        answer = np.empty(len(key), np.uint32)
        flag = np.zeros(len(key), bool)
        if n == 1:
            flag[order] = (np.add.reduceat(counts[1][order].astype(np.int64), at) > 0)[run]
        else:
            learners = np.flatnonzero(learnt > 0)
            _, first = np.unique(run[learners], return_index=True)
            flag[order[learners[first]]] = True
        answer[order] = np.minimum(total, 2**31 - 1).astype(np.uint32)[run]
        answer |= flag * _FLAG
        cuts = np.r_[0, np.cumsum(sizes)]
        seen = total[total > 0]
        totals = np.r_[np.bincount(np.minimum(seen, K + 2), minlength=K + 3)[1 : K + 2], len(seen), seen.sum()].astype(np.int64)
        cell = part["cell"][0].as_py()
        rows = len(sizes) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(rows, n, np.int32)), pa.array(np.full(rows, cell, np.int32)),
             pa.array([*part["block"].to_pylist(), -1], pa.int64()),
             pa.array([*(answer[a:b].tobytes() for a, b in zip(cuts, cuts[1:])), totals.tobytes()], pa.binary())],
            ["ngram", "cell", "block", "answer"],
        )


def discounts(by_count: np.ndarray) -> np.ndarray:
    """Share of a count r = 1..K that is kept, from the numbers of n-grams with counts 1..K+1."""
    n = by_count.astype(float)
    out = np.array([(r - 0.5) / r for r in range(1, K + 1)])
    if n[0] > 0:
        common = (K + 1) * n[K] / n[0]
        for r in range(1, K + 1):
            if n[r - 1] > 0 and common < 1:
                d = ((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common)
                if 0 < d < 1:
                    out[r - 1] = d
    return out


def kept(count: np.ndarray, discount: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    low = discount[np.clip(count, 1, K) - 1] * count
    return np.where(count > K, count - LARGE, np.where(count > 0, low, 0.0))


class Model:
    """The totals of the model: what is left of a count, and the mass of unseen words."""

    def __init__(self, totals: dict[int, np.ndarray]):
        none = np.zeros(K + 3, np.int64)
        one, two = totals.get(1, none), totals.get(2, none)
        self.words, self.tokens = int(one[K + 1]), int(one[K + 2])
        self.discount = discounts(one[: K + 1]), discounts(two[: K + 1])
        self.left = 1.0
        if self.tokens:
            low = ((1 - self.discount[0]) * np.arange(1, K + 1) * one[:K]).sum()
            self.left = (low + LARGE * (self.words - one[:K].sum())) / self.tokens

    def single(self, count: np.ndarray) -> np.ndarray:
        """Probability of a word by its training count; the unknown word's where that is 0."""
        seen = kept(count, self.discount[0]) / max(1, self.tokens)
        return np.where(count > 0, seen, self.left)


ROWS = (
    "kind int, slot bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint,"
    " history bigint, base_score double, score double"
)


def _scored(model: Model, cells: int):
    """Kind 0: a document's row, all but its backoff weights. Kind 1: the seen mass of a history, and
    the mass of the same words one order below, of the pairs that this block accounts for. Kind 2:
    how often a document backs off from a history."""

    def rows(kind: int, n: int, **columns) -> pa.RecordBatch:
        names = ["slot", "doc_id", "held_out", "n_tokens", "n_known", "history", "base_score", "score"]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        arrays = [pa.array(columns[c], t) if c in columns and not isinstance(columns[c], pa.Array)
                  else columns.get(c, pa.nulls(n, t)) for c, t in zip(names, kinds)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *arrays], ["kind", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in batch.schema.names}
                block = Block(row, cells)
                got: dict[tuple, bytes] = {(a["ngram"], a["cell"]): a["answer"] for a in row["answers"]}
                count, flag = [], []
                for n, (order, cell, _, at) in enumerate(block.orders, 1):
                    own = np.empty(len(order), np.uint32)
                    for a, b in zip(at, at[1:]):
                        own[order[a:b]] = np.frombuffer(got[n, int(cell[a])], np.uint32)
                    count.append((own & ~_FLAG).astype(np.int64))
                    flag.append((own & _FLAG) > 0)
                end = int(np.flatnonzero(block.vocabulary == END)[0])
                of_history = np.r_[count[0], count[0][end]]  # the start comes once in each text
                single = model.single(count[0])
                h, w = block.pair
                seen = count[1] > 0
                after = np.maximum(of_history[h], 1)
                logs = np.where(
                    seen, np.log10(np.maximum(kept(count[1], model.discount[1]), 1e-300) / after), np.log10(single[w])
                )
                backs = ~seen & (of_history[h] > 0)
                base = np.log10((count[0] + 1) / (model.tokens + model.words + 1))
                docs = len(block.lengths)
                slot = (row["block"] << 20) + np.arange(docs) if docs < 1 << 20 else row["block"] * docs + np.arange(docs)
                yield rows(
                    0, docs, slot=slot, doc_id=pa.array(block.doc_ids, mask=block.nulls), held_out=~block.train,
                    n_tokens=block.lengths, n_known=np.bincount(block.doc, count[0][block.tokens] > 0, docs).astype(np.int64),
                    base_score=np.bincount(block.doc, base[block.tokens], docs),
                    score=np.bincount(block.doc, logs[block.which], docs),
                )
                mine = np.flatnonzero(flag[1] & np.r_[flag[0], True][h])  # histories that texts outside training have
                if len(mine):
                    masses = kept(count[1][mine], model.discount[1]) / after[mine]
                    histories, at = np.unique(h[mine], return_inverse=True)
                    names = np.r_[block.vocabulary, START][histories].view(np.int64)
                    yield rows(1, len(names), history=names, base_score=np.bincount(at, single[w[mine]]), score=np.bincount(at, masses))
                where = np.flatnonzero(backs[block.which])
                if len(where):
                    size = len(of_history)
                    code, times = np.unique(block.doc[where] * size + block.before[where], return_counts=True)
                    names = np.r_[block.vocabulary, START][code % size].view(np.int64)
                    for a in range(0, len(code), 100_000):
                        own = slice(a, a + 100_000)
                        yield rows(2, len(code[own]), slot=slot[code[own] // size], n_tokens=times[own], history=names[own])

    return run


def score(docs: DataFrame) -> DataFrame:
    """Scores of all texts by a model of those with ``train``: columns ``doc_id``, ``text``, ``train``.

    doc_id, held_out, n_tokens (words and the end), n_known (seen in training), train_tokens,
    base_score (add-one single words) and score, both log10. Words are folded A-Z. A null or empty
    text is its end alone. Repeated rows are scored each, and learnt each. Without training rows
    every token is unknown. Words are 64-bit and pairs 56-bit hashes.
    """
    cells = parts_for(docs, CELL)
    held = stored(blocks(docs))
    asked = held.mapInArrow(_questions(cells), ASKED).withColumn("place", F.col("cell") * 2 + F.col("ngram") - 1)
    answers = stored(
        asked.repartition(2 * cells, "place").sortWithinPartitions("place").mapInArrow(
            _answers, "ngram int, cell int, block bigint, answer binary"
        ),
        "ngram",
    )
    totals: dict[int, np.ndarray] = {}
    for row in answers.where("block = -1").select("ngram", "answer").toLocalIterator():  # two a cell
        own = np.frombuffer(bytes(row["answer"]), np.int64)
        totals[row["ngram"]] = totals.get(row["ngram"], 0) + own
    model = Model(totals)
    told = answers.where("block >= 0").groupBy("block").agg(
        F.collect_list(F.struct("ngram", "cell", "answer")).alias("answers")
    )
    out = stored(held.join(told, "block").mapInArrow(_scored(model, cells), ROWS), "kind")
    dropped(held)
    dropped(answers)
    weight = (
        out.where("kind = 1").groupBy("history").agg(F.sum("score").alias("seen"), F.sum("base_score").alias("lower"))
        .select("history", F.log10((1 - F.col("seen")) / (1 - F.col("lower"))).alias("weight"))
    )
    backed = (
        out.where("kind = 2").select("slot", "history", "n_tokens").join(weight, "history")
        .groupBy("slot").agg(F.sum(F.col("n_tokens") * F.col("weight")).alias("backed"))
    )
    return out.where("kind = 0").join(backed, "slot", "left").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score",
        (F.col("score") + F.coalesce("backed", F.lit(0.0))).alias("score"),
    )


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs.select("doc_id", "text", (remainder("doc_id", 7) != 2).alias("train")))
