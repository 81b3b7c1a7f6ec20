"""Packing along a space-filling curve.

Each document becomes token ids, a hashed vector of its tokens, a point in three dimensions and
the point's place on a Hilbert curve. A range sort by that place brings like documents together,
and each range is packed gaplessly into sequences.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urnframe.llm.store import stored, table
from urnframe.llm.text import slices

BUCKETS, DIMS, BITS = 256, 3, 10
END = 0

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint,"
    " sequence_id bigint, offset bigint"
)
_loaded: dict[str, "Tokens"] = {}


class Tokens:
    """Token ids of texts, as 16-bit values.

    A single space between two other characters always begins a new piece of the vocabulary's
    pattern, so a text without other runs of spaces is the ids of its words, one after the other.
    """

    def __init__(self, ranks_file: str, json_file: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(1 << 16, np.int64)  # bytes of each id
        self.sizes[list(ranks.values())] = [len(x) for x in ranks]
        self.json_file = json_file
        self.special = "<|endoftext|>"
        self.whole = None

    def encode(self, text: str) -> np.ndarray:
        if self.special in text:  # the special token's own text has an id of its own
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.json_file)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2")
        return np.array(self.encoding.encode_ordinary(text), "<u2")

    def encode_all(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), each with the end id behind, and the bounds of each text's ids.

        Each different word of the column is encoded once, all of them as one text.
        """
        rows = len(column)
        if not rows:
            return np.zeros(0, "<u2"), np.zeros(1, np.int64)
        column = pc.fill_null(column, "")
        split = pc.split_pattern(column, " ")
        bounds = np.asarray(split.offsets)
        words = split.values.dictionary_encode()
        code, words = np.asarray(words.indices), words.dictionary
        heads = bounds[:-1]
        sizes = np.asarray(pc.binary_length(words), np.int64)
        # beside other space, or beside none: such texts, and those with the special token, are encoded whole
        odd = (sizes == 0) | (np.asarray(pc.binary_length(pc.utf8_trim_whitespace(words))) < sizes)
        flags = odd[code]
        flags[heads] &= sizes[code[heads]] > 0
        whole = np.logical_or.reduceat(flags, heads)
        whole |= pc.match_substring(column, self.special).to_numpy(zero_copy_only=False)
        inside = np.repeat(whole, np.diff(bounds))
        plain = ~inside
        plain[heads] = False
        used = np.zeros(len(words), bool)
        used[code[plain]] = True
        kept = words.filter(pa.array(used))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept), " ")[0].as_py()
        ids = self.encode(" " + joined if len(kept) else "")
        cuts = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(sizes[used] + 1)) + 1
        firsts = pc.if_else(pa.array(whole), column, split.values.take(pa.array(heads)))
        firsts = [self.encode(x) for x in firsts.to_pylist()]
        # the ids of each word, of the first word (or the whole text) of each row, of the end, and of nothing
        counts = np.zeros(len(words) + rows + 2, np.int64)
        counts[: len(words)][used] = np.diff(cuts, prepend=0)
        counts[len(words) : -2] = [len(x) for x in firsts]
        counts[-2] = 1
        starts = np.cumsum(counts) - counts
        pool = np.concatenate([ids, *firsts, np.array([END], "<u2")])
        code = np.where(inside, len(counts) - 1, code)
        code[heads] = np.arange(len(words), len(words) + rows)
        code = np.insert(code, bounds[1:], len(counts) - 2)
        each = counts[code]
        ends = np.cumsum(each)
        at = np.repeat(starts[code] - (ends - each), each)
        at += np.arange(len(at))
        return pool[at], np.append(0, ends[bounds[1:] + np.arange(rows)])


def tokens_of(name: str) -> Tokens:
    """The tokenizer of a vocabulary, loaded once per Python process."""
    if name not in _loaded:
        from public_tokenizers import path

        _loaded[name] = Tokens(path(f"{name}.tiktoken"), path(f"{name}.json"))
    return _loaded[name]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on a Hilbert curve of points with ``bits``-bit coordinates, one row per point.

    Skilling's transform (2004), over all points at once: undo the excess rotations from the
    highest bit down, Gray-encode, and interleave the bits.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> bit) & 1)
    return place


def _projection(vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Signed bucket of each token id (negative ones follow), and the fixed random plane of the buckets."""
    rng = np.random.default_rng(1891)
    bucket = rng.integers(0, BUCKETS, vocabulary)
    sign = rng.choice([-1.0, 1.0], vocabulary)
    return bucket + BUCKETS * (sign < 0), rng.normal(size=(BUCKETS, DIMS))


def _place(ids: np.ndarray, bounds: np.ndarray, fixed: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    bucket, plane = fixed
    points = np.zeros((len(bounds) - 1, DIMS))
    for i, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        plus, minus = np.bincount(bucket[ids[low:high]], minlength=2 * BUCKETS).reshape(2, BUCKETS)
        vector = (plus - minus).astype(float)
        points[i] = (vector / max(np.linalg.norm(vector), 1e-12)) @ plane
    unit = 1 / (1 + np.exp(-1.7 * points))  # near the normal distribution's: even use of the cube
    return hilbert(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def token_table(docs: DataFrame, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """Token ids (16-bit, with the end id) and curve place of each row, and a number for the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(vocabulary)
        fixed = _projection(1 << 16)
        slot = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text", 1 << 24):
                ids, bounds = tokens.encode_all(part["text"])
                offsets = (bounds * 2).astype(np.int32)
                bodies = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                slots = np.arange(slot, slot + len(part))
                slot += len(part)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(_place(ids, bounds, fixed)), pa.array(slots), bodies],
                    ["doc_id", "place", "slot", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, place bigint, slot bigint, ids binary")


def _tail(length: int) -> list[int]:
    """A length below a power of two, as falling powers of two."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


class _Packer:
    """Cuts a stream of documents into full sequences; the rest waits for more."""

    def __init__(self, size: int, first: int):
        self.size, self.sequence = size, first
        self.ids = np.zeros(0, "<u2")
        self.docs = np.zeros((0, 4), np.int64)  # doc_id, start in the doc, length here, doc_tokens
        self.nulls = np.zeros(0, bool)

    def add(self, doc_id: np.ndarray, null: np.ndarray, bodies: list[bytes]) -> None:
        lengths = np.array([len(x) // 2 for x in bodies], np.int64)
        rows = np.stack([doc_id, np.zeros_like(lengths), lengths, lengths], 1)
        self.docs = np.concatenate([self.docs, rows])
        self.nulls = np.concatenate([self.nulls, null])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(bodies), "<u2")])

    def take(self, sizes: np.ndarray) -> pa.RecordBatch:
        """Emit the next sequences, of these sizes."""
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(self.docs[:, 2])
        begins = ends - self.docs[:, 2]
        at = np.union1d(begins[begins < cuts[-1]], cuts)
        low, high = at[:-1], at[1:]
        doc = np.searchsorted(ends, low, "right")
        of = np.searchsorted(cuts, low, "right") - 1
        own = self.docs[doc]
        body = self.ids[: cuts[-1]].astype("<u4")
        offsets = (np.append(low, cuts[-1]) * 4).astype(np.int32)
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(own[:, 0], mask=self.nulls[doc]),
                pa.array(own[:, 1] + low - begins[doc]),
                pa.array(high - low),
                pa.Array.from_buffers(pa.binary(), len(low), [None, pa.py_buffer(offsets), pa.py_buffer(body)]),
                pa.array(own[:, 3]),
                pa.array(self.sequence + of),
                pa.array(low - cuts[of]),
            ],
            ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )
        self.sequence += len(sizes)
        keep = ends > cuts[-1]
        rest = self.docs[keep].copy()
        if len(rest):
            used = max(0, cuts[-1] - begins[keep][0])
            rest[0, 1] += used
            rest[0, 2] -= used
        self.docs, self.nulls, self.ids = rest, self.nulls[keep], self.ids[cuts[-1] :]
        return out


def pack(tokens: DataFrame, size: int = 1024) -> DataFrame:
    """Pack documents along the curve into sequences of at most ``size`` ids, without padding.

    Neighbours on the curve meet in a range; ties are split by row, so a group of copies may span
    ranges. Full sequences are cut gaplessly; the rest of a range fills sequences whose sizes are
    falling powers of two. ``ids`` holds little-endian unsigned 32-bit ids. A null or empty text
    is one end id; a repeated row is packed again; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(size, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                doc_id = part["doc_id"]
                packer.add(
                    np.asarray(pc.fill_null(doc_id, 0), np.int64),
                    np.asarray(pc.is_null(doc_id)),
                    part["ids"].to_pylist(),
                )
                if full := len(packer.ids) // size:
                    yield packer.take(np.full(full, size, np.int64))
        if len(packer.ids):
            yield packer.take(np.array(_tail(len(packer.ids)), np.int64))

    ordered = tokens.repartitionByRange("place", "slot").sortWithinPartitions("place", "slot")
    return ordered.select("doc_id", "ids").mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, size: int = 1024, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """Tokenise once into a written table, then range-sort and pack (see ``pack``).

    Columns other than ``doc_id`` and ``text`` are ignored.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    return pack(stored(token_table(docs, vocabulary)), size)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack_documents(table(spark, sf_dir, "documents")))
