"""Cross-tokenizer alignment with corpus-wide counts of linked ids, behind minimal perfect hashes.

The first pass cuts each text into groups where tokens of both vocabularies end, and sends the
different linked pairs of a block of documents with their counts to hash cells. A cell builds a
minimal perfect hash of its different pairs; counts become dense vectors indexed by that hash and
are summed as a tree: within branches of blocks, then over branches. Keys are kept in hash order, so
that every lookup is verified. The second pass aligns the documents again and reads the counts.

Why texts may be cut into units first. A unit begins at a blank that follows a visible ASCII character.
The pattern of vocabulary A never puts a character other than white space and a following blank into
one piece, and no piece of vocabulary B holds a blank behind another character, so no merge of either
crosses such a place. Units are aligned once and remembered.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urnframe.llm.store import parts_for, stored, table
from urnframe.llm.text import U64, mix, raw, slices

BLOCK = 8 << 20  # bytes of text in a block of documents; a longer text is a block of its own
CELL = 32 << 20  # bytes of input files that make one cell
CELLS = 1 << 14  # at most: 50,257 x 32,000 ids make fewer than 100,000 pairs for each of so many cells
FAN = 4096  # blocks of a branch
UNITS = 600_000  # units that a Python process remembers
SPACE = "▁"


class MinimalHash:
    """A minimal perfect hash of different 64-bit keys: numbers 0 to n-1 without a gap.

    Level by level, keys that are alone at their place of a bit array stay there; the others go on
    to the next level. A key's number is the count of bits before its own.
    """

    ROOM = 1.7  # places for each key of a level

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, int]] = []  # places, bits, keys of earlier levels
        total = 0
        while len(keys):
            size = max(64, int(self.ROOM * len(keys)) | 1)
            at = self._place(keys, len(self.levels), size)
            once = np.bincount(at, minlength=size) == 1
            self.levels.append((size, np.packbits(once), total))
            total += int(once.sum())
            keys = keys[~once[at]]
        self.size = total

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ mix(np.full(1, level * 0x9E3779B9 + 1, np.uint64))) % U64(size)).astype(np.int64)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; of a key that was not among the first ones any number, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, packed, before) in enumerate(self.levels):
            if not len(left):
                break
            at = self._place(keys[left], level, size)
            bits = np.unpackbits(packed, count=size)
            found = bits[at] == 1
            ranks = np.cumsum(bits, dtype=np.int64)
            out[left[found]] = before + ranks[at[found]] - 1
            left = left[~found]
        return out


class Aligner:
    """Units of texts and their alignment under two vocabularies."""

    def __init__(self, a: str = "byte_bpe_50k", b: str = "piece_bpe_32k"):
        import base64

        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN, path

        with open(path(f"{a}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.b = sentencepiece.SentencePieceProcessor(model_file=path(f"{b}.model"))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.bytes_b = [
            bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace(SPACE, " ").encode() for p in pieces
        ]
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.bytes_a[i] = piece
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.names = [f"{i}{sign}" for pieces_of, signs in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for sign in signs for i in range(len(pieces_of))]
        self.blank = [self.b.piece_to_id(SPACE)]
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.grouped = False
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.texts: list[str] = []  # groups of every unit, as text that ends with ";"
        self.table = np.zeros((0, 4), np.int64)  # fits, tokens of A, tokens of B, links
        self.links = np.zeros(0, np.uint64)
        self.first = np.zeros(1, np.int64)

    def _encode(self, units: list[str], joined: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of all units in a row and how many each has, under both vocabularies.

        The first ``joined`` units end with a visible character, so A may read them as one text.
        """
        ids = np.array(self.a("".join(units[:joined])) if joined else [], np.int64)
        sizes = np.cumsum(list(map(len, map(str.encode, units[:joined]))), dtype=np.int64)
        n = np.diff(np.searchsorted(np.cumsum(self.size_a[ids]), sizes, "right"), prepend=0)
        rest = [self.a(u) for u in units[joined:]]
        a = np.concatenate([ids, np.fromiter(chain.from_iterable(rest), np.int64)]), np.concatenate([n, np.array(list(map(len, rest)), np.int64)])
        lists = self.b.encode([u[1:] for u in units], num_threads=1) if units else []
        lists = [x if len(u) > 1 else self.blank for u, x in zip(units, lists)]
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        return [a, (np.fromiter(chain.from_iterable(lists), np.int64, n.sum()), n)]

    def _fits(self, units: list[str], ids: np.ndarray, n: np.ndarray, pieces: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Whether the tokens of each unit spell it."""
        raw = [u.encode() for u in units]
        spelt = list(map(pieces.__getitem__, ids.tolist()))
        ends = np.concatenate([[0], np.cumsum(sizes[ids])])[np.cumsum(n)]
        if b"".join(spelt) == b"".join(raw) and (ends == np.cumsum(list(map(len, raw)))).all():
            return np.ones(len(units), bool)
        at = np.cumsum(n) - n
        return np.array([b"".join(spelt[i : i + k]) == r for i, k, r in zip(at.tolist(), n.tolist(), raw)], bool)

    def _learn(self, units: list[str], joined: int, texts: bool) -> None:
        """Align new units; their codes follow those of the known ones."""
        for u in units:
            self.code[u] = len(self.code)
        (a, n_a), (b, n_b) = self._encode(units, joined)
        ok = self._fits(units, a, n_a, self.bytes_a, self.size_a) & self._fits(units, b, n_b, self.bytes_b, self.size_b)
        if not ok.all():
            a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
        n_a, n_b = n_a * ok, n_b * ok
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        total = int(ends_a[-1]) if len(a) else 0
        in_a, in_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        in_a[ends_a] = in_b[ends_b] = True
        last_a, last_b = in_b[ends_a], in_a[ends_b]  # the last token of a group
        links = (a[last_a].astype(np.uint64) << U64(32)) | b[last_b].astype(np.uint64)
        n_links = np.diff(np.concatenate([[0], np.cumsum(last_a)])[np.concatenate([[0], np.cumsum(n_a)])])
        if texts:
            # tokens in the order of the text: a group's of A, then its of B, each with the sign behind it
            group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
            order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
            names = np.concatenate([a + last_a * len(self.bytes_a), 2 * len(self.bytes_a) + b + last_b * len(self.bytes_b)])
            parts = list(map(self.names.__getitem__, names[order].tolist()))
            ends = np.cumsum(n_a + n_b).tolist()
            self.texts += ["".join(parts[i:j]) for i, j in zip([0, *ends], ends)]
        self.table = np.concatenate([self.table, np.stack([ok, n_a, n_b, n_links], 1)])
        self.links = np.concatenate([self.links, links])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(n_links)])

    def units(self, texts: list[str | None], groups: bool) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the units of all texts, and where each text begins and ends in them.

        Texts that are null or empty, or whose tokens do not spell blank and text, have no units.
        With ``groups`` the units' ``texts`` are there, too.
        """
        if len(self.code) > UNITS or groups != self.grouped:
            self.forget()
        self.grouped = groups
        data, bounds = raw(pa.array([" " + t if t else "" for t in texts], pa.string()))
        cut = np.zeros(len(data), bool)
        if self.cuts:
            cut[1:] = (data[1:] == 32) & (data[:-1] > 32) & (data[:-1] < 127)
        cut[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        start = np.flatnonzero(cut)
        offsets = pa.py_buffer(np.append(start, len(data)).astype(np.int32))
        known = pa.StringArray.from_buffers(len(start), offsets, pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        names = known.dictionary.to_pylist()
        fresh = [u for u in names if u not in self.code]
        if fresh:
            ends = [u for u in fresh if not "!" <= u[-1] <= "~"]  # ends of texts
            main = [u for u in fresh if "!" <= u[-1] <= "~"]
            self._learn(main + ends, len(main), groups)
        codes = np.fromiter(map(self.code.__getitem__, names), np.int64, len(names))[np.asarray(known.indices)]
        bounds = np.searchsorted(start, bounds)
        if self.table[codes, 0].all():
            return codes, bounds
        each = np.split(codes, bounds[1:-1])
        each = [self._whole(" " + t) if len(own) and not self.table[own, 0].all() else own for t, own in zip(texts, each)]
        return np.concatenate(each), np.cumsum([0, *map(len, each)])

    def _whole(self, text: str) -> np.ndarray:
        """A text as one unit, if its tokens spell it."""
        if text not in self.code:
            self._learn([text], 0, self.grouped)
        own = np.array([self.code[text]])
        return own if self.table[own[0], 0] else own[:0]


_aligner: dict[str, Aligner] = {}


def aligner() -> Aligner:
    """The vocabularies, loaded once per Python process."""
    if not _aligner:
        _aligner[""] = Aligner()
    return _aligner[""]


def blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """Documents packed into numbered blocks of about ``size`` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text", size):
                one = np.array([0, part.num_rows], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), *(pa.ListArray.from_arrays(one, part[c]) for c in ("doc_id", "text"))],
                    ["block", "doc_ids", "texts"],
                )
                number += 1

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "block bigint, doc_ids array<bigint>, texts array<string>")


class Linked:
    """The different linked pairs of a block's documents, by cell, and how often each is linked."""

    def __init__(self, texts: list[str | None], cells: int, groups: bool = False):
        self.of = aligner()
        self.codes, self.bounds = self.of.units(texts, groups)
        self.used, self.times = np.unique(self.codes, return_counts=True)
        n = self.of.table[self.used, 3]
        start = np.cumsum(n) - n
        at = np.arange(n.sum()) - np.repeat(start - self.of.first[self.used], n)
        pairs, self.which = np.unique(self.of.links[at], return_inverse=True)
        counts = np.bincount(self.which, np.repeat(self.times, n), len(pairs)).astype(np.int64)
        self.unit = np.repeat(np.arange(len(self.used)), n)  # of each link of the used units
        cell = (mix(pairs) % U64(cells)).astype(np.int64)
        self.order = np.argsort(cell, kind="stable")
        self.cell, self.pairs, self.counts = cell[self.order], pairs[self.order], counts[self.order]
        self.cuts = np.flatnonzero(np.r_[True, self.cell[1:] != self.cell[:-1], True]) if len(pairs) else np.zeros(1, int)


def _asked(cells: int, branches: int):
    """First pass: a block's pairs and counts for every cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = Linked(batch["texts"][i].as_py(), cells)
                spans = list(zip(own.cuts, own.cuts[1:]))
                block = batch["block"][i].as_py()
                branch = int(mix(np.array([block], np.uint64))[0] % U64(branches))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(own.cell[a]) for a, _ in spans], pa.int32()), pa.array([branch] * len(spans), pa.int32()),
                     pa.array([block] * len(spans), pa.int64()),
                     pa.array([own.pairs[a:b].tobytes() for a, b in spans], pa.binary()),
                     pa.array([own.counts[a:b].tobytes() for a, b in spans], pa.binary())],
                    ["cell", "branch", "block", "keys", "counts"],
                )

    return run


def _keys(column: pa.ChunkedArray, kind: type = np.uint64) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), kind) for x in column] or [np.zeros(0, kind)])


def _union(part: pa.Table) -> pa.Table:
    keys = np.unique(_keys(part["keys"]))
    return pa.table({"cell": part["cell"].slice(0, 1), "keys": pa.array([keys.tobytes()], pa.binary())})


def _built(part: pa.Table) -> pa.Table:
    """A cell's hash, and its keys in the order of their numbers."""
    keys = np.unique(_keys(part["keys"]))
    hashed = MinimalHash(keys)
    placed = np.empty_like(keys)
    placed[hashed.numbers(keys)] = keys
    return pa.table({
        "cell": part["cell"].slice(0, 1), "hash": pa.array([pickle.dumps(hashed)], pa.binary()),
        "placed": pa.array([placed.tobytes()], pa.binary()),
    })


def _found(keys: np.ndarray, hashes: pa.Table) -> np.ndarray:
    """Numbers of keys that the hash was built from; each is verified."""
    placed = np.frombuffer(hashes["placed"][0].as_py(), np.uint64)
    at = pickle.loads(hashes["hash"][0].as_py()).numbers(keys)
    if len(keys) and not (placed[at] == keys).all():
        raise ValueError("a key is not in the hash")
    return at


def _dense(asked: pa.Table, hashes: pa.Table) -> pa.Table:
    """The counts of a branch of blocks as one dense vector."""
    if not asked.num_rows:
        return pa.table({"cell": pa.array([], pa.int32()), "vector": pa.array([], pa.binary())})
    keys, counts = _keys(asked["keys"]), _keys(asked["counts"], np.int64)
    vector = np.zeros(len(hashes["placed"][0].as_py()) // 8, np.int64)
    np.add.at(vector, _found(keys, hashes), counts)
    return pa.table({"cell": asked["cell"].slice(0, 1), "vector": pa.array([vector.tobytes()], pa.binary())})


def _summed(part: pa.Table) -> pa.Table:
    vector = sum(np.frombuffer(x.as_py(), np.int64) for x in part["vector"])
    return pa.table({"cell": part["cell"].slice(0, 1), "vector": pa.array([vector.tobytes()], pa.binary())})


def _highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The highest count of each B id in a cell."""
    for batch in batches:
        for i in range(batch.num_rows):
            placed = np.frombuffer(batch["placed"][i].as_py(), np.uint64)
            counts = np.frombuffer(batch["vector"][i].as_py(), np.int64)
            ids, which = np.unique(placed & U64(0xFFFFFFFF), return_inverse=True)
            top = np.zeros(len(ids), np.int64)
            np.maximum.at(top, which, counts)
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(top)], ["id", "top"])


def _told(best: dict[int, int]):
    """Counts for every block of a branch, in the order of its keys; negative where not the highest of the B id."""

    def run(asked: pa.Table, hashes: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "cell": pa.array([], pa.int32()), "answer": pa.array([], pa.binary())})
        vector = np.frombuffer(hashes["vector"][0].as_py(), np.int64)
        sizes = [len(x.as_py()) // 8 for x in asked["keys"]]
        keys = _keys(asked["keys"])
        counts = vector[_found(keys, hashes)]
        top = np.array([best[int(b)] for b in keys & U64(0xFFFFFFFF)], np.int64)
        counts = np.where(counts == top, counts, -counts)
        cuts = np.cumsum([0, *sizes])
        answers = [counts[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        return pa.table({"block": asked["block"], "cell": asked["cell"], "answer": pa.array(answers, pa.binary())})

    return run


ROWS = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
)


def _aligned(cells: int):
    """Second pass: each document's alignment again, with the counts of its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = Linked(batch["texts"][i].as_py(), cells, groups=True)
                got = {a["cell"]: a["answer"] for a in batch["answers"][i].as_py() or []}
                counts = np.zeros(len(own.pairs), np.int64)
                for a, b in zip(own.cuts, own.cuts[1:]):
                    counts[own.order[a:b]] = np.frombuffer(got[int(own.cell[a])], np.int64)
                link = counts[own.which]  # of each link of the used units
                size = len(own.used)
                per_unit = np.zeros((size, 5), np.int64)
                per_unit[:, :3] = own.of.table[own.used, 1:]
                per_unit[:, 3] = np.bincount(own.unit, link > 0, size)
                np.add.at(per_unit[:, 4], own.unit, np.abs(link))
                at = np.searchsorted(own.used, own.codes)
                sums = np.zeros((len(own.bounds) - 1, 5), np.int64)
                full = np.flatnonzero(own.bounds[1:] > own.bounds[:-1])
                if len(full):
                    sums[full] = np.add.reduceat(per_unit[at], own.bounds[:-1][full], axis=0)
                hashes = []
                for a, b in zip(own.bounds.tolist(), own.bounds[1:].tolist()):
                    digest = hashlib.sha256()
                    for k in range(a, b, 1 << 18):  # a long text's groups are joined in parts
                        end = min(b, k + (1 << 18))
                        text = "".join(map(own.of.texts.__getitem__, own.codes[k:end].tolist()))
                        digest.update((text[:-1] if end == b else text).encode())
                    hashes.append(digest.hexdigest() if b > a else "")
                n_a, n_b, links, best, total = sums.T
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_ids"][i].values, *map(pa.array, (n_a, n_b, links, links, best, total)), pa.array(hashes, pa.string())],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )

    return run


def align(docs: DataFrame, size: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Token groups of every text under both vocabularies and corpus-wide counts of their links.

    doc_id, n_a and n_b tokens, n_groups, n_links, n_best (links whose pair is counted most often
    among the pairs of its B id, ties included), count_sum (counts over the links) and groups_sha256.
    A link is the last token of A and of B in a group. Texts that are null, empty, or not spelt by
    both vocabularies have zeros and an empty hash, and link nothing. Repeated rows are counted and
    answered each; other columns are ignored.
    """
    cells = min(parts_for(docs, CELL), CELLS)
    held = stored(blocks(docs, size))
    branches = max(1, -(-held.count() // fan))
    asked = stored(held.mapInArrow(_asked(cells, branches), "cell int, branch int, block bigint, keys binary, counts binary"))
    keys = asked.select("cell", "branch", "keys")
    if branches > 1:
        keys = keys.groupBy("cell", "branch").applyInArrow(_union, "cell int, keys binary")
    hashes = stored(keys.groupBy("cell").applyInArrow(_built, "cell int, hash binary, placed binary"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(branches - 1))).alias("branch")
    by_branch = asked.groupBy("cell", "branch")
    vectors = by_branch.cogroup(hashes.select("cell", "hash", "placed", everywhere).groupBy("cell", "branch")).applyInArrow(
        _dense, "cell int, vector binary"
    )
    totals = stored(hashes.join(vectors.groupBy("cell").applyInArrow(_summed, "cell int, vector binary"), "cell"))
    tops = totals.mapInArrow(_highest, "id bigint, top bigint").groupBy("id").agg(F.max("top").alias("top"))
    best = {r["id"]: r["top"] for r in tops.collect()}  # one number for each B id
    answers = asked.groupBy("cell", "branch").cogroup(totals.select("*", everywhere).groupBy("cell", "branch")).applyInArrow(
        _told(best), "block bigint, cell int, answer binary"
    )
    told = answers.groupBy("block").agg(F.collect_list(F.struct("cell", "answer")).alias("answers"))
    return held.join(told, "block", "left").mapInArrow(_aligned(cells), ROWS)


def op12_pair_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
