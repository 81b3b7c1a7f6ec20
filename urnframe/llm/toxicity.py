"""Toxicity by a convolutional text classifier over hashed word embeddings, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urnframe.llm.calibration import platt
from urnframe.llm.sampling import remainder
from urnframe.llm.store import free_name, passing, stored, table
from urnframe.llm.text import U64, Words, slices

BUCKETS = 1 << 15
SIZE = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
SHARD = 8192  # labelled texts that one task learns from, about
DEALT = 512  # ids that are dealt to the folds together, about
ROUNDS = 2  # passes over several shards; after each, what the shards learnt is averaged
BLOCKS = 64  # blocks of a net's parameters, each averaged apart
GRID, REACH = 1024, 64  # unseen rows' logits are counted in steps of 1 / GRID, up to REACH
NETS = 3  # each learns from all folds but its own; the score is the mean of their logits
CLEAN_LOSS = 0.02  # share of clean calibration rows that a threshold may reject
ENOUGH = 20  # toxic calibration rows that a language needs for a threshold of its own


def pieces(words: Words, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed parts of words, from which their embeddings are averaged: which word (in order), which bucket."""
    of, keys = [np.arange(len(start))], [words.span(start, end, 21)]
    for n in (4, 5, 6):
        long = np.flatnonzero(end - start >= n)
        of.append(long)
        keys.append(words.span(start[long], start[long] + n, 30 + n))
    word, key = words.grams(start, end, 4, 40)
    of.append(word)
    keys.append(key)
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return of[order], (np.concatenate(keys)[order] % U64(BUCKETS)).astype(np.int64)


def _embed(e: np.ndarray, of: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    """Mean embedding of each of ``n`` words; every one has a part."""
    parts = np.bincount(of, minlength=n)
    return np.add.reduceat(e[bucket], np.cumsum(parts) - parts, axis=0) / parts[:, None].astype(e.dtype)


class Net:
    """Embeddings, one bank of filters per width, max pooling and a logistic layer."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        f4 = np.float32
        self.e = rng.normal(scale=0.03, size=(BUCKETS, SIZE)).astype(f4)
        self.w = [rng.normal(scale=0.5 / np.sqrt(k), size=(k, SIZE, FILTERS)).astype(f4) for k in WIDTHS]
        self.b = [np.zeros(FILTERS, f4) for _ in WIDTHS]
        self.v = rng.normal(scale=0.3, size=len(WIDTHS) * FILTERS).astype(f4)
        self.c = f4(0)

    def parameters(self) -> list[np.ndarray]:
        return [self.e, *self.w, *self.b, self.v]

    def flat(self) -> np.ndarray:
        return np.concatenate([*(p.ravel() for p in self.parameters()), [self.c]]).astype(np.float32)

    @classmethod
    def of(cls, flat: np.ndarray) -> Net:
        net = cls()
        at = 0
        for p in net.parameters():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        net.c = np.float32(flat[at])
        return net

    def pooled(self, emb: np.ndarray, which: np.ndarray, bounds: np.ndarray, where: bool = False):
        """Per row the highest response of every filter (0 at least), and where it is.

        ``which`` is the words' number in ``emb``; ``bounds`` cuts the words into rows. Windows
        lie inside one row; a row with fewer words than a width has response 0 there.
        """
        rows = len(bounds) - 1
        out = np.zeros((rows, len(WIDTHS) * FILTERS), np.float32)
        at = np.full(out.shape, -1, np.int64)
        for j, k in enumerate(WIDTHS):
            have = np.flatnonzero(bounds[1:] - bounds[:-1] >= k)
            if not len(have):
                continue
            z = (emb @ self.w[j][0])[which[: len(which) - k + 1]]
            for i in range(1, k):
                z += (emb @ self.w[j][i])[which[i : len(which) - k + 1 + i]]
            ends = bounds[have + 1] - k + 1
            cuts = np.stack([bounds[have], ends], 1).ravel()
            # each row's windows, then the windows that cross into the next row, and so on
            spans = np.minimum(cuts, len(z) - 1)
            best = np.maximum.reduceat(z, spans, axis=0)[::2]
            last = cuts[-1] > len(z) - 1  # the last row's windows run to the end
            if last:
                best[-1] = z[cuts[-2] :].max(0)
            best = best + self.b[j]
            cols = slice(j * FILTERS, (j + 1) * FILTERS)
            out[have, cols] = np.maximum(best, 0)
            if where:
                for r, a, b in zip(have, bounds[have], ends):
                    at[r, cols] = a + z[a:b].argmax(0)
        return out, at

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.v + self.c


class Adam:
    """Adam over minibatches; gradients reach only the windows that won the pooling.

    A row is its different words' parts (which word, bucket) and its words as numbers of these.
    """

    def __init__(self, net: Net, rate: float = 0.003):
        self.net, self.rate, self.step = net, rate, 0
        self.first = [np.zeros_like(p) for p in net.parameters()]
        self.second = [np.zeros_like(p) for p in net.parameters()]

    def learn(self, batch: list, label: np.ndarray) -> None:
        net, y = self.net, label.astype(np.float32)
        n_words = np.cumsum([0] + [x[2] for x in batch])
        of = np.concatenate([x[0] + n for x, n in zip(batch, n_words)])
        bucket = np.concatenate([x[1] for x in batch])
        which = np.concatenate([x[3] + n for x, n in zip(batch, n_words)])
        bounds = np.cumsum([0] + [len(x[3]) for x in batch])
        total = int(n_words[-1])
        emb = _embed(net.e, of, bucket, total) if total else np.zeros((0, SIZE), np.float32)
        h, at = net.pooled(emb, which, bounds, where=True) if total else (
            np.zeros((len(batch), len(net.v)), np.float32), np.full((len(batch), len(net.v)), -1))
        g = 1 / (1 + np.exp(-net.scores(h))) - y
        g /= len(batch)
        gv, gc = h.T @ g, g.sum()
        gh = g[:, None] * net.v * (h > 0)
        gw = [np.zeros_like(w) for w in net.w]
        gb = [np.zeros_like(b) for b in net.b]
        gemb = np.zeros((total, SIZE), np.float32)
        for j, width in enumerate(WIDTHS):
            for f in range(FILTERS):
                col = j * FILTERS + f
                won = np.flatnonzero((at[:, col] >= 0) & (gh[:, col] != 0))
                pull = gh[won, col]
                gb[j][f] = pull.sum()
                for i in range(width):
                    word = which[at[won, col] + i]
                    gw[j][i, :, f] = emb[word].T @ pull
                    np.add.at(gemb, word, pull[:, None] * net.w[j][i, :, f])
        touched = np.flatnonzero(gemb.any(1))
        ge = np.zeros_like(net.e)
        if len(touched):
            share = np.bincount(of, minlength=total)
            mark = np.zeros(total, bool)
            mark[touched] = True
            own = mark[of]
            pull, own = gemb[of[own]] / share[of[own], None], bucket[own]
            for i in range(SIZE):
                ge[:, i] = np.bincount(own, pull[:, i], BUCKETS)
        self.step += 1
        for p, grad, m, v in zip(net.parameters(), [ge, *gw, *gb, gv], self.first, self.second):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            p -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)
        net.c = np.float32(net.c - self.rate * gc)


def train(rows: list, label: np.ndarray, epochs: int = 6, least: int = 400, size: int = 20, net: Net | None = None) -> Net:
    """``epochs`` passes over the rows in changing order, ``least`` steps at least."""
    adam = Adam(net or Net())
    rng = np.random.default_rng(9)
    for _ in range(max(epochs, -(-least * size // max(1, len(rows))))):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), size):
            adam.learn([rows[i] for i in order[k : k + size]], label[order[k : k + size]])
    return adam.net


def features(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """Of each text the different words' parts (which word, bucket), how many words these are, and the
    text's words as numbers of these."""
    for part in slices(batch, "text"):
        words = Words(part["text"])
        bounds = np.concatenate([[0], np.cumsum(words.counts)])
        for a, b in zip(bounds, bounds[1:]):
            _, at, which = np.unique(words.key[a:b], return_index=True, return_inverse=True)
            of, bucket = pieces(words, words.start[a:b][at], words.end[a:b][at])
            yield of.astype(np.int32), bucket.astype(np.uint16), len(at), which.astype(np.int32)


def logits(nets: list[Net], texts: pa.Array) -> np.ndarray:
    """Mean logit of every text under the nets; a text without words has none but their constants."""
    words = Words(texts)
    if not len(words.key):
        return np.full(len(texts), np.mean([net.c for net in nets]), np.float64)
    _, at, which = np.unique(words.key, return_index=True, return_inverse=True)
    of, bucket = pieces(words, words.start[at], words.end[at])
    bounds = np.concatenate([[0], np.cumsum(words.counts)])
    return np.mean(
        [net.scores(net.pooled(_embed(net.e, of, bucket, len(at)), which, bounds)[0]) for net in nets],
        axis=0, dtype=np.float64,
    )


def _threshold(score: np.ndarray, y: np.ndarray, clean_loss: float = CLEAN_LOSS, times: np.ndarray | None = None) -> float:
    """The cut with the best F1 among those with at most a share of ``clean_loss`` of label 0 above.

    A cut lies in the middle between two different scores; rows of one score are never parted.
    Without a cut of this kind, and where label 1 is absent, nothing is rejected (a cut above 1).
    An entry stands for ``times`` rows, or for one.
    """
    order = np.argsort(-score, kind="stable")
    each = np.ones(len(score), np.int64) if times is None else times[order]
    ranked, hit = score[order], (y[order] == 1) * each
    last = np.flatnonzero(np.diff(ranked, append=-np.inf) < 0)  # the last row of each score
    hits, n = np.cumsum(hit)[last], np.cumsum(each)[last]
    fine = (n - hits <= clean_loss * (each.sum() - hit.sum())) & (hits > 0)
    if not fine.any():
        return 2.0
    k = int(np.argmax(np.where(fine, 2 * hits / (n + hit.sum()), -1)))
    below = ranked[last[k] + 1] if last[k] + 1 < len(ranked) else 0.0
    return float((ranked[last[k]] + below) / 2)


@passing()
def fit(docs: DataFrame, labels: DataFrame, shard: int = SHARD) -> dict:
    """Learn ``labels.toxic`` from every labelled text.

    ``NETS`` nets are each trained without one fold of the rows, in shards of about ``shard`` rows whose
    nets are averaged. A row's logit under the net that did not see it sets the scale of the scores
    and the threshold of each language with ``ENOUGH`` toxic rows; others use the threshold of all.
    All these logits are counted by Spark in steps of 1 / ``GRID``. A doc_id with two labels counts
    as toxic. Without labelled rows every score is 0 and nothing is rejected.
    """
    rows = stored(_labelled(docs, labels))
    size = rows.count()
    if not size:
        net = Net()
        net.v[:] = 0
        return {"nets": [net], "scale": (1.0, -30.0), "thresholds": {"": 2.0}}
    shards = max(1, round(size / shard))
    nets = [Net(3 + k) for k in range(NETS)]
    for _ in range(ROUNDS if shards > 1 else 1):
        nets = _round(rows, nets, shards, everyone=size < NETS)
    counts = stored(_counts(rows, nets))
    own = counts.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    own = own.where((F.col("_p") >= ENOUGH) & (F.col("_p") < F.col("_n")))
    # at most 2 * REACH * GRID + 1 rows, and as many of each language with a threshold of its own
    total = counts.groupBy("z").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).orderBy("z").toArrow()
    each = counts.join(own, "lang", "left_semi").orderBy("lang", "z").toArrow()

    def listed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z, p, n = (table[c].to_numpy() for c in ("z", "p", "n"))
        return np.concatenate([z, z]) / GRID, np.repeat([1, 0], len(z)), np.concatenate([p, n - p])

    z, y, times = listed(total)
    scale = platt(z, y, times)

    def threshold(z: np.ndarray, y: np.ndarray, times: np.ndarray) -> float:
        some = times > 0
        score = 1 / (1 + np.exp(-np.clip(scale[0] * z + scale[1], -500, 500)))
        return _threshold(score[some], y[some], times=times[some])

    thresholds = {"": threshold(z, y, times)}
    names = np.array(each["lang"].to_pylist(), object)
    for name in dict.fromkeys(names):
        thresholds[name] = threshold(*listed(each.filter(pa.array(names == name))))
    return {"nets": nets, "scale": scale, "thresholds": thresholds}


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every labelled row with its label, its fold and a hash as its order.

    Rows of one doc_id share a fold. Each fold has its share of both labels: ids are dealt in the order of
    a hash, in groups of about ``DEALT`` ids.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = stored(known.join(docs.select("doc_id"), "doc_id", "left_semi"))
    by_hash = F.xxhash64("doc_id", F.lit(7))
    group = F.pmod(by_hash, F.lit(max(1, round(known.count() / DEALT))))
    dealt = W.partitionBy(group, "toxic").orderBy(by_hash, "doc_id")
    placed = stored(known.withColumn("fold", ((F.row_number().over(dealt) + group) % NETS).cast("int")))  # Spark knows its size
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.join(placed, "doc_id").withColumn("order", F.xxhash64("doc_id", "text", F.lit(5)))


def _round(rows: DataFrame, nets: list[Net], shards: int, everyone: bool = False) -> list[Net]:
    """The nets after a pass over all rows.

    One shard alone is learnt by each net in a task of its own, in several epochs. Several shards are
    each learnt in one task, once, in small batches. A parameter moves by the mean of the shards
    that moved it; the means are taken by Spark, block by block.
    """
    shared = rows.sparkSession.sparkContext.broadcast([net.flat() for net in nets])  # fixed size
    shard = F.pmod("order", F.lit(shards)).cast("int").alias("shard")
    every = F.array(*[F.lit(k) for k in range(NETS)])
    if shards > 1:
        dealt = rows.select(shard, F.lit(-1).alias("net"), "order", "fold", "toxic", "text")
    else:
        dealt = rows.select(shard, F.explode(every).alias("net"), "order", "fold", "toxic", "text")
        dealt = dealt.where(F.lit(everyone) | (F.col("net") != F.col("fold")))

    def learnt(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("order")
        out = []
        if shards > 1:
            learners = {k: Adam(Net.of(shared.value[k])) for k in range(NETS)}
            for batch in table.combine_chunks().to_batches(max_chunksize=600):
                texts, fold, label = list(features(batch)), np.asarray(batch["fold"]), np.asarray(batch["toxic"])
                for k, adam in learners.items():
                    own = np.flatnonzero(fold != k)
                    for i in range(0, len(own), 20):
                        adam.learn([texts[j] for j in own[i : i + 20]], label[own[i : i + 20]])
            nets = {k: adam.net for k, adam in learners.items()}
        else:
            k = key[1].as_py()
            texts = [x for batch in table.combine_chunks().to_batches() for x in features(batch)]
            nets = {k: train(texts, table["toxic"].to_numpy(), net=Net.of(shared.value[k]))}
        for k, net in nets.items():
            moved = np.array_split(net.flat() - shared.value[k], BLOCKS)
            out += [(key[0].as_py(), k, i, block.tobytes()) for i, block in enumerate(moved)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], ["shard", "net", "block", "moved"])

    def mean(key: tuple, table: pa.Table) -> pa.Table:
        total, times = 0.0, 0
        for moved in table.sort_by("shard")["moved"].to_pylist():
            own = np.frombuffer(moved, np.float32)
            total, times = total + own.astype(np.float64), times + (own != 0)
        step = (total / np.maximum(times, 1)).astype(np.float32)
        return pa.table([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([step.tobytes()])], ["net", "block", "moved"])

    shards_out = dealt.groupBy("shard", "net").applyInArrow(learnt, "shard int, net int, block int, moved binary")
    steps = shards_out.groupBy("net", "block").applyInArrow(mean, "net int, block int, moved binary").toArrow()
    out = [np.array_split(net.flat(), BLOCKS) for net in nets]
    for k, i, moved in zip(*(steps[c].to_pylist() for c in ("net", "block", "moved"))):
        out[k][i] = out[k][i] + np.frombuffer(moved, np.float32)
    return [Net.of(np.concatenate(blocks)) for blocks in out]


TYPES = (pa.int32(), pa.int32(), pa.int32(), pa.binary())


def _counts(rows: DataFrame, nets: list[Net]) -> DataFrame:
    """How many rows (``n``) and toxic rows (``p``) of each language have each logit (``z`` steps of 1 / ``GRID``)
    under the net that did not see them."""
    shared = rows.sparkSession.sparkContext.broadcast(nets)  # fixed size

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, net in enumerate(shared.value):
                for part in slices(batch.filter(pc.equal(batch["fold"], k)), "text"):
                    z = np.rint(np.clip(logits([net], part["text"]), -REACH, REACH) * GRID).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part["lang"], part["toxic"], pa.array(z)], ["lang", "toxic", "z"])

    seen = rows.select("text", "lang", "toxic", "fold").mapInArrow(unseen, "lang string, toxic int, z int")
    return seen.groupBy("lang", "z").agg(F.sum("toxic").alias("p"), F.count("*").alias("n"))


def score_texts(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (``doc_id`` by default) and ``score``, the calibrated probability of label 1.

    The score depends on the text alone. A null or empty text gets the score of no words at all.
    Kept columns may have any names; one named ``score`` gives way to the new column.
    """
    keep = [c for c in keep or ["doc_id"] if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast((model["nets"], model["scale"]))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nets, (a, b) = shared.value
        for batch in batches:
            # the text comes first; the other columns are known by their place
            for part in slices(batch.rename_columns(["text", *(f"c{i}" for i in range(len(keep)))]), "text"):
                score = 1 / (1 + np.exp(-np.clip(a * logits(nets, part["text"]) + b, -500, 500)))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(score)], [*keep, "score"])

    name = free_name(keep, "text")
    rows = docs.select(F.col("text").cast("string").alias(name), *keep)
    schema = docs.select(*keep).schema.add("score", "double")
    return rows.mapInArrow(run, schema)


def thresholds_by_language(model: dict, lang: Column) -> Column:
    """The threshold of each row's language, or of all languages."""
    out = F.lit(model["thresholds"].get("", 0.5))
    for name, value in model["thresholds"].items():
        if name:
            out = F.when(lang == name, F.lit(value)).otherwise(out)
    return out


def rejected(docs: DataFrame, model: dict, score: str = "score", flag: str = "rejected") -> DataFrame:
    """All columns of ``docs``, then ``score`` and the boolean ``flag``: the score reaches the threshold
    of the row's ``lang``.

    A language without enough labelled rows uses the threshold of all, so does a table without
    ``lang``. The threshold never touches the score. Columns of ``docs`` may have any name; those
    named like the two new ones give way to them.
    """
    names = [c for c in docs.columns if c not in (score, flag)]
    kept = [free_name(docs.columns, f"_{i}") for i in range(len(names))]
    plain = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(names, kept)), F.col("text"))
    scored = score_texts(plain, model, kept)
    lang = F.col(kept[names.index("lang")]).cast("string") if "lang" in names else F.lit(None).cast("string")
    return scored.select(
        *(F.col(k).alias(c) for c, k in zip(names, kept)),
        F.col("score").alias(score),
        (F.col("score") >= thresholds_by_language(model, lang)).alias(flag),
    )


def op8_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs.where(remainder("doc_id", 5) != 0), labels.where(remainder("doc_id", 5) != 0))
    return score_texts(docs, model).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
