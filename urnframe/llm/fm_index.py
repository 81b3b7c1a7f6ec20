"""Substring deduplication by a compressed FM-index per shard.

A window is ``window`` consecutive words. Each window picks the least hash among its short runs of
words as its anchor; equal windows pick equal anchors, so they meet in the shard of the anchor.
Consecutive windows of one anchor form a segment. Each different segment of a shared anchor is entered
once in the FM-index of its shard, with the number of its uses. What is used twice is repeated as a
whole; the others are streamed against the index: backward search over a wavelet matrix gives matching
statistics, where an interval counts the uses of the segments that it lies in. Windows that are
counted twice are repeats wherever their segment is used.

An anchor with very many different segments is split by more context: windows in which the anchor lies
late share the words before it, the others the words behind it. Halving the range of places again and
again ends at windows that are equal as a whole, so every key is bounded and no window is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urnframe.llm.signature_join import runs_of
from urnframe.llm.store import stored, table
from urnframe.llm.text import BASE, U64, Words, mix, shingles, slices

WINDOW = 35
ANCHOR = 8  # words of the runs among which a window's anchor is chosen
SHARD = 400_000  # words of a shard
HOT = 4_000  # different segments of a key above which it is split by more words around the anchor
NEAR = 500_000  # texts whose keys may be broadcast; above, the same join is a shuffle
_PLACE = 24


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the 96-bit hash of the text: copies of a text share all their answers."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"),
        F.xxhash64(text).alias("k"), F.hash(text).alias("m"),
    )


def segments_of(words: Words, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Row, first word, number of windows, anchor hash, words before the anchor and content hash of every segment."""
    keys, n = words.key, len(words.key)
    parts = []
    step = 1 << (_PLACE - 1)
    first_word = np.concatenate([[0], np.cumsum(words.counts)])
    for base in range(0, max(n - window + 1, 0), step):  # one part, but for a giant text
        own = keys[base : base + step + window - 1]
        row = words.row[base : base + len(own)]
        gram = shingles(own, anchor)
        place = np.arange(len(gram), dtype=np.uint64)
        ranked = ((gram >> U64(_PLACE)) << U64(_PLACE)) | place
        span, least = 1, ranked
        wide = window - anchor + 1
        while span * 2 <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < wide:
            rest = wide - span
            least = np.minimum(least[:-rest], least[rest:])
        at = (least & U64((1 << _PLACE) - 1)).astype(np.int64)  # each window's anchor place
        inside = row[: len(own) - window + 1] == row[window - 1 :]
        starts = np.flatnonzero(inside & np.r_[True, (at[1:] != at[:-1]) | ~inside[:-1] | (row[1 : len(at)] != row[: len(at) - 1])])
        if not len(starts):
            continue
        ends = np.flatnonzero(inside & np.r_[(at[1:] != at[:-1]) | ~inside[1:] | (row[1 : len(at)] != row[: len(at) - 1]), True])
        count = ends - starts + 1
        parts.append((row[starts], starts + base, count, gram[at[starts]], at[starts] - starts))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), none, np.zeros(0, np.uint64)
    row, start, count, gram, ahead = (np.concatenate(x) for x in zip(*parts))
    up = np.cumprod(np.r_[U64(1), np.full(n, BASE, np.uint64)], dtype=np.uint64)
    down = np.cumprod(np.r_[U64(1), np.full(n, pow(BASE, -1, 2**64), np.uint64)], dtype=np.uint64)
    sums = np.r_[U64(0), np.cumsum(keys * up[:n], dtype=np.uint64)]
    end = start + count + window - 1
    content = mix((sums[end] - sums[start]) * down[start] + count.astype(np.uint64))
    return row, start - first_word[row], count, gram, ahead, content


def segments(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, start, count, gram, ahead, content = segments_of(Words(part["text"], lower=False), window, anchor)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"].take(at), part["k"].take(at), part["m"].take(at), pa.array(start.astype(np.int32)),
                     pa.array(count.astype(np.int32)), pa.array(ahead.astype(np.int32)), pa.array(gram.view(np.int64)),
                     pa.array(content.view(np.int64))],
                    ["doc_id", "k", "m", "start", "windows", "ahead", "anchor", "content"],
                )

    return docs.mapInArrow(
        run, "doc_id bigint, k bigint, m int, start int, windows int, ahead int, anchor bigint, content bigint"
    )


class WaveletMatrix:
    """Ranks of symbols in a sequence: one packed bit row per level, with counts per 64 bits."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.depth = max(1, int(size - 1).bit_length())
        self.rows = []
        now = symbols
        for level in range(self.depth - 1, -1, -1):
            bit = ((now >> level) & 1).astype(np.uint8)
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, np.uint8)
            padded[: len(bit)] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]].astype(np.int32)
            self.rows.append((packed, before, len(bit) - int(bit.sum())))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.base = self._map(np.arange(size), np.zeros(size, np.int64))

    def _map(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (packed, before, zeros) in zip(range(self.depth - 1, -1, -1), self.rows):
            word = at >> 6
            below = (U64(1) << (at & 63).astype(np.uint64)) - U64(1)
            ones = before[word] + np.bitwise_count(packed[word] & below)
            at = np.where((symbol >> level) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol comes before each place."""
        return self._map(symbol, at) - self.base[symbol]


class FMIndex:
    """Counts of word sequences in a set of texts, by backward search; a text counts as often as it is used."""

    def __init__(self, texts: list[np.ndarray], uses: np.ndarray | None = None):
        lengths = np.array([len(t) for t in texts])
        words = np.concatenate(texts)
        self.names, number = np.unique(words, return_inverse=True)
        ends = np.cumsum(lengths + 1) - 1
        body = np.zeros(int(lengths.sum()) + len(texts), np.int64)
        mark = np.zeros(len(body), bool)
        mark[ends] = True
        body[~mark] = number.ravel() + 1
        self.starts = ends - lengths
        # ends of texts differ from each other, so no suffix equals another beyond its text
        order_key = np.where(mark, 0, body + len(texts))
        order_key[ends] = np.arange(len(texts))
        suffix = self._sorted(order_key, int(lengths.max()) + 1)
        before = body[suffix - 1]
        self.body, self.first = body, np.r_[0, np.cumsum(np.bincount(body, minlength=len(self.names) + 1))]
        self.matrix = WaveletMatrix(before, len(self.names) + 1)
        own = np.ones(len(texts), np.int64) if uses is None else uses
        self.upto = np.r_[0, np.cumsum(np.repeat(own, lengths + 1)[suffix])]  # uses of the suffixes before a place

    @staticmethod
    def _sorted(key: np.ndarray, reach: int) -> np.ndarray:
        """Suffixes in order, told apart by their first ``reach`` symbols: ranks of doubling length."""
        _, rank = np.unique(key, return_inverse=True)
        rank, span, n = rank.ravel().astype(np.int64), 1, len(key)
        while True:
            after = np.zeros(n, np.int64)
            after[:-span] = rank[span:] + 1
            pair = rank * (n + 2) + after
            order = np.argsort(pair, kind="stable")
            step = np.r_[0, np.cumsum(pair[order][1:] != pair[order][:-1])]
            rank = np.empty(n, np.int64)
            rank[order] = step
            span *= 2
            if span >= reach or step[-1] == n - 1 or span >= n:
                return order

    def statistics(self, text: np.ndarray, most: int, wanted: int = 2) -> np.ndarray:
        """For each place of ``text`` (symbols of ``body``), the length, up to ``most``, of the longest
        run that ends there and that the texts, by their uses, hold ``wanted`` times."""
        length = np.zeros(len(text), np.int64)
        live = np.arange(len(text))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), len(self.body))
        for k in range(most):
            live_at = live - k
            ok = live_at >= 0
            live, low, high, live_at = live[ok], low[ok], high[ok], live_at[ok]
            symbol = text[live_at]
            ok = symbol > 0
            live, low, high, symbol = live[ok], low[ok], high[ok], symbol[ok]
            if not len(live):
                break
            low = self.first[symbol] + self.matrix.rank(symbol, low)
            high = self.first[symbol] + self.matrix.rank(symbol, high)
            ok = self.upto[high] - self.upto[low] >= wanted
            live, low, high = live[ok], low[ok], high[ok]
            length[live] = k + 1
        return length


def _search(window: int):
    """Repeated windows of the entries of each shard, as runs of words from the entry's beginning.

    All entries are in the index. An entry that is used twice is counted twice as a whole by its own
    uses; the others are streamed against the index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs_of(batches, "shard"):
            part = part.combine_chunks()
            bodies = [np.frombuffer(x, np.uint64) for x in part["words"].to_pylist()]
            lengths = np.array(list(map(len, bodies)), np.int64)
            uses = np.asarray(part["uses"])
            index = FMIndex(bodies, uses)
            ask = np.flatnonzero(uses == 1)
            of = start = many = np.zeros(0, np.int64)
            if len(ask):
                # the asked entries, each behind a separator
                offset = np.cumsum(lengths[ask] + 1) - lengths[ask]
                place = np.arange(offset[-1] + lengths[ask[-1]]) - np.repeat(offset - index.starts[ask], lengths[ask] + 1)
                text = index.body[np.maximum(place, 0)]
                text[offset - 1] = 0
                hit = np.flatnonzero(index.statistics(text, window) >= window)
                at = np.searchsorted(offset, hit, "right") - 1
                begin = hit - offset[at] - window + 1
                first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (begin[1:] != begin[:-1] + 1)]) if len(hit) else hit
                of, start = ask[at[first]], begin[first]
                many = np.diff(np.r_[first, len(hit)]) + window - 1 if len(hit) else hit
            often = np.flatnonzero(uses > 1)
            rows = pa.array(np.r_[often, of])
            yield pa.RecordBatch.from_arrays(
                [part["key"].combine_chunks().take(rows), part["piece"].combine_chunks().take(rows),
                 pa.array(np.r_[np.zeros(len(often), np.int64), start].astype(np.int32)),
                 pa.array(np.r_[lengths[often], many].astype(np.int32))],
                ["key", "piece", "begin", "length"],
            )

    return run


def _contents(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of wanted segments, read from the texts that hold them."""
    names = ["anchor", "content", "uses", "start", "windows", "ahead"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part["text"], lower=False)
                bounds = np.concatenate([[0], np.cumsum(words.counts)])
                lists = part["wanted"]
                flat = lists.flatten()
                of = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lists.offsets)))
                columns = dict(zip((f.name for f in flat.type), flat.flatten()))
                start, windows = np.asarray(columns["start"]), np.asarray(columns["windows"])
                bodies = [
                    words.key[bounds[r] + s : bounds[r] + s + n + window - 1].tobytes()
                    for r, s, n in zip(of, start, windows)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(columns[c] for c in names if c != "start"), pa.array(bodies, pa.binary())],
                    [*(c for c in names if c != "start"), "words"],
                )

    each = wanted.groupBy("k", "m", "doc_id").agg(F.collect_list(F.struct(*names)).alias("wanted"))
    each = stored(each)
    nobody = F.lit(-(2**63))
    rows = docs.withColumn("doc_id", F.coalesce("doc_id", nobody))
    if each.count() <= NEAR:
        near = F.broadcast(each.select("k", "m", "doc_id"))
        rows = rows.join(near, ["k", "m", "doc_id"], "left_semi")
    joined = rows.dropDuplicates(["k", "m", "doc_id"]).join(each, ["k", "m", "doc_id"])
    return joined.select("text", "wanted").mapInArrow(
        run, "anchor bigint, content bigint, uses bigint, windows int, ahead int, words binary"
    )


PIECE = (
    "anchor bigint, content bigint, key bigint, piece bigint, begin int, low int, windows int, ahead int, uses bigint, words binary"
)


def _split(window: int, width: int):
    """Pieces whose anchor lies at ``low`` to ``low + width - 1`` words of a window, cut in two halves of places.

    All windows of a half hold the same words around the anchor; these, with the key so far, are its key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            half = width // 2
            for r in batch.to_pylist():
                words = np.frombuffer(r["words"], np.uint64)
                late = int(min(r["windows"], max(0, r["ahead"] - r["low"] - half + 1)))  # windows with the anchor in the upper half
                for skip, n, low, wide in ((0, late, r["low"] + half, width - half), (late, r["windows"] - late, r["low"], half)):
                    if n > 0:
                        ahead = r["ahead"] - skip
                        own = words[skip : skip + n + window - 1]
                        common = own[ahead - low : ahead - low - wide + 1 + window]
                        name = lambda x, *more: int(shingles(np.r_[x, np.array(more, np.uint64)], len(x) + len(more))[0].view(np.int64))
                        key = name(common, r["key"] % 2**64, low, wide)
                        rows.append({
                            **r, "key": key, "piece": name(own, ahead, n), "begin": r["begin"] + skip, "low": low, "windows": n,
                            "ahead": ahead, "words": own.tobytes(),
                        })
            yield pa.RecordBatch.from_pylist(rows, batch.schema)

    return run


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Runs of words (k, m, start, length) that are covered by repeated windows, by text."""
    keyed = _keyed(docs)
    found = stored(segments(keyed, window, anchor))
    often = stored(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    shared = stored(found.join(often, "anchor", "left_semi"))
    nobody = F.lit(-(2**63))
    kinds = shared.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("uses"),
        F.min(F.struct("k", "m", F.coalesce("doc_id", nobody).alias("doc_id"), "start", "windows", "ahead")).alias("one"),
    )
    texts = _contents(keyed, stored(kinds.select("anchor", "content", "uses", "one.*")), window)
    now = stored(texts.select(
        "anchor", "content", F.col("anchor").alias("key"), F.col("content").alias("piece"), F.lit(0).alias("begin"),
        F.lit(0).alias("low"), "windows", "ahead", "uses", "words",
    ))
    entries, deep, width = None, None, window - anchor + 1
    while True:
        # equal pieces of split segments are one entry with all their uses
        own = now if entries is None else now.groupBy("key", "piece").agg(F.sum("uses").alias("uses"), F.min("words").alias("words"))
        own = own.select("key", "piece", "uses", "words")
        hot = stored(own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key"))
        last = width == 1 or hot.isEmpty()
        kept = own if last else own.join(hot, "key", "left_anti")
        entries = kept if entries is None else entries.unionByName(kept)
        if last:
            break
        split = now.join(hot, "key", "left_semi").select(*now.columns)
        now = stored(split.mapInArrow(_split(window, width), PIECE))
        deep = now if deep is None else deep.unionByName(now)
        width -= width // 2
    entries = stored(entries)
    size = entries.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0] // 8
    shards = max(1, -(-size // SHARD))
    dealt = entries.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    runs = stored(
        dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(
            _search(window), "key bigint, piece bigint, begin int, length int"
        )
    )
    whole = runs.select(F.col("key").alias("anchor"), F.col("piece").alias("content"), "begin", "length")
    if deep is not None:
        placed = deep.select("anchor", "content", "key", "piece", F.col("begin").alias("_at"))
        inner = placed.join(runs, ["key", "piece"]).select("anchor", "content", (F.col("_at") + F.col("begin")).alias("begin"), "length")
        whole = stored(whole.unionByName(inner))
    return shared.join(whole, ["anchor", "content"]).select("k", "m", (F.col("start") + F.col("begin")).alias("start"), "length").distinct()


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept``: the other words, joined by one space.

    A word goes if a window that covers it starts anywhere else too, in the same text or another;
    windows are judged on the input. A text with fewer words than a window keeps all; a null text
    has no words. Repeated rows are copies of each other. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, gone, kept = [], [], []
                for text, start, length in zip(part["text"].to_pylist(), part["starts"].to_pylist(), part["lengths"].to_pylist()):
                    words = text.encode().split()
                    n.append(len(words))
                    if start:
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, np.array(start), 1)
                        np.add.at(edge, np.array(start) + np.array(length), -1)
                        stay = np.cumsum(edge[:-1]) == 0
                        gone.append(len(words) - int(stay.sum()))
                        words = [w for w, ok in zip(words, stay) if ok]
                    else:
                        gone.append(0)
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    runs = repeats(docs, window, anchor).groupBy("k", "m").agg(F.collect_list(F.struct("start", "length")).alias("runs"))
    joined = _keyed(docs).join(runs, ["k", "m"], "left").select(
        "doc_id", "text", F.col("runs.start").alias("starts"), F.col("runs.length").alias("lengths")
    )
    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def op10_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )
