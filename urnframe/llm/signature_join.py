"""Exact n-gram Jaccard join by signature trees.

A document is the set of its 5-word shingles. Documents that could be similar to another are found
by an exact prefix count, gathered into groups that share rare shingles, and joined group by group
with signature trees: a node holds the OR of its documents' token bitmaps and their size range,
and a dual traversal prunes pairs of nodes by the largest overlap they allow.

Why no link is lost. Let two sets of sizes a and b have overlap o with 100*o >= 80*(a+b-o). Then
o >= 0.8*max(a, b). Order all shingles by their hash. Any overlap of o leaves at most a-o of A's
shingles unshared, so among A's first a-ceil(0.8a)+L and B's first b-ceil(0.8b)+L shingles at
least L are shared. With L = max(1, floor(SPARE/100*size)) for each set, the pair shares at least
the smaller L of the two, and the smaller set has at least 0.8 of the larger one's size. Among
these first shingles the same argument holds for any order, so it is enough to compare the rarest.

Boilerplate and chance join many documents that are not similar into wide groups. These are grouped
again by all shingles of their sets: a set keeps the rarest of the shingles that others of wide
groups have, but for those that it needs for an overlap of 0.8 of its size. By the same argument
two similar sets share one of them; a set with fewer shingles of others than it needs drops out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urnframe.llm.store import numbered, parts_for, passing, stored, table
from urnframe.llm.text import U64, Words, mix, shingles, slices

N = 5
PERCENT = 80
CELL = 8 << 20  # bytes of input files whose shingles make one cell
SPARE = 8  # percent of a set by which its prefix is longer than one shared shingle needs
CHUNK = 1_000_000  # shingles of a group that are joined at a time
NEAR = 500_000  # ids that may be broadcast to read their texts; above, the same join is a shuffle
WIDE = 2_000  # documents of a group that is grouped again by whole sets, as is one of several chunks
HUBS = 64  # documents of a larger group that every chunk of it meets
BITS = 8  # of a document's signature for each shingle of a mean set of its job
GATHER = 16 << 20  # bytes of signatures that are compared at a time
NAME = np.dtype([("a", "<u8"), ("b", "<u4"), ("n", "<u4")])  # the key of a set


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """The sorted different shingle hashes of every row; fewer words than ``n`` are one shingle."""
    bounds = np.concatenate([[0], np.cumsum(words.counts)])
    out = []
    for a, b in zip(bounds, bounds[1:]):
        keys = words.key[a:b]
        if b - a >= n:
            out.append(np.unique(shingles(keys, n)))
        elif b > a:
            out.append(shingles(keys, int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _set_key(own: np.ndarray) -> bytes:
    """96 bits that stand for a set, two sums of mixed shingles, and its size."""
    with np.errstate(over="ignore"):
        a = np.add.reduce(mix(own ^ U64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64) if len(own) else U64(0)
        b = np.add.reduce(mix(own + U64(0x5DEECE66D)), dtype=np.uint64) if len(own) else U64(0)
    return int(a).to_bytes(8, "little") + (int(b) >> 32).to_bytes(4, "little") + len(own).to_bytes(4, "little")


def least_shared(size: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Shingles that a set must share with a similar one: ``ceil(percent/100 * size)``."""
    return -(-percent * size // 100)


def least_overlap(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Shingles that similar sets of these sizes, or larger ones, share at least: of a union of ``a + b - overlap``."""
    return -(-percent * (a + b) // (100 + percent))


def _spare(size: np.ndarray | int) -> np.ndarray | int:
    return np.maximum(1, SPARE * size // 100)


def _prefix(size: int, percent: int) -> int:
    return min(size, size - least_shared(size, percent) + int(_spare(size)))


def _needed(size: np.ndarray, percent: int) -> np.ndarray:
    """Shared shingles among the prefixes: the spare of the smallest set that could be similar."""
    return _spare(least_shared(size, percent))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def set_rows(docs: DataFrame, n: int) -> DataFrame:
    """Size and key of every document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(Words(part["text"]), n)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([_set_key(s) for s in sets], pa.binary())], ["doc_id", "n", "set_key"])

    return _plain(docs).mapInArrow(run, "doc_id bigint, n bigint, set_key binary")


def _cell_row(sets: dict[bytes, np.ndarray], cells: int) -> pa.RecordBatch:
    """Shingles packed by cell: a row has those that fall into a cell, and for each the key of its set."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets.values()])
    key = np.concatenate([*sets.values()])
    cell = ((key * U64(0x9E3779B97F4A7C15)) >> U64(32)) % U64(cells)
    order = np.lexsort((key, cell))
    key, owner, cell = key[order], owner[order], cell[order].astype(np.int32)
    at = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
    set_keys = np.frombuffer(b"".join(sets), "V16")
    bodies, owners = [], []
    for a, b in zip(at, at[1:]):
        bodies.append(key[a:b].tobytes())
        mine, local = np.unique(owner[a:b], return_inverse=True)
        owners.append(
            np.uint32(len(mine)).tobytes() + set_keys[mine].tobytes()
            + local.astype(np.uint16 if len(mine) < 65536 else np.uint32).tobytes()
        )
    return pa.RecordBatch.from_arrays(
        [pa.array(cell[at[:-1]]), pa.array(bodies, pa.binary()), pa.array(owners, pa.binary())], ["cell", "keys", "owners"])


PACKED = "cell int, keys binary, owners binary"


def prefix_cells(docs: DataFrame, n: int, percent: int, cells: int) -> DataFrame:
    """The prefixes of all sets, packed: a row per cell and slice of documents.

    Copies within a slice are one set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                sets = shingle_sets(Words(part["text"]), n)
                heads = {_set_key(s): s[: _prefix(len(s), percent)] for s in sets if len(s)}
                if heads:
                    yield _cell_row(heads, cells)

    return _plain(docs).mapInArrow(run, PACKED)


def whole_cells(sets: DataFrame, cells: int) -> DataFrame:
    """All shingles of loaded sets, packed as by ``prefix_cells``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "keys", 4 << 20):
                names, keys = part["set_key"].to_pylist(), part["keys"].to_pylist()
                yield _cell_row({k: np.frombuffer(x, np.uint64) for k, x in zip(names, keys)}, cells)

    return sets.select("set_key", "keys").mapInArrow(run, PACKED)


def _unpack(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of packed rows, the place of each one's set, and the keys of the sets (once a row)."""
    keys, places, names, m = [], [], [], 0
    for body, packed in zip(part["keys"].to_pylist(), part["owners"].to_pylist()):
        own = np.frombuffer(body, np.uint64)
        k = int(np.frombuffer(packed, np.uint32, 1)[0])
        names.append(np.frombuffer(packed, NAME, k, 4))
        places.append(np.frombuffer(packed, np.uint16 if k < 65536 else np.uint32, len(own), 4 + 16 * k) + np.int64(m))
        keys.append(own)
        m += k
    return np.concatenate(keys), np.concatenate(places), np.concatenate(names)


def runs_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The rows of each value of ``column``, of a partition that is sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        value = np.asarray(batch[column])
        cuts = np.flatnonzero(np.r_[True, value[1:] != value[:-1], True]) if len(value) else []
        for a, b in zip(cuts, cuts[1:]):
            piece = batch.slice(a, b - a)
            if held and held[0][column][0] != piece[column][0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held)


def _shared_counts(buckets: int):
    """Packed shingles that several sets have, and how many.

    They are packed: a row per cell and bucket of set keys has a set key, a shingle and a count
    per place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs_of(batches, "cell"):
            key, place, names = _unpack(part)
            order = np.argsort(key)
            key, place = key[order], place[order]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            uses = np.diff(np.r_[at, len(key)])
            several = np.repeat(uses > 1, uses)
            if not several.any():
                continue
            # the same set may come from two slices: count different sets of a shingle
            used, who = np.unique(place[several], return_inverse=True)
            names, same = np.unique(names[used], return_inverse=True)
            pair = np.unique(np.repeat(np.arange(len(at)), uses)[several] * len(names) + same[who])
            run, who = np.divmod(pair, len(names))
            count = np.bincount(run)[run]
            run, who, count = run[count > 1], who[count > 1], count[count > 1].astype(np.uint32)
            if not len(run):
                continue
            bucket = (names["a"][who] % U64(buckets)).astype(np.int32)
            order = np.lexsort((run, who, bucket))
            name, key, count, bucket = names[who[order]], key[at[run[order]]], count[order], bucket[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            packed = [pa.array([x[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()) for x in (name, key, count)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), *packed], ["bucket", "names", "keys", "counts"])

    return run


def _rarest(needed: Callable[[np.ndarray], np.ndarray]):
    """Of each candidate set, the shared shingles among its rarest; see the module's proof.

    Shingles that no other set has are the rarest, so they use up places: of ``s`` shared
    ones ``s - needed + 1`` are left. A set with fewer than ``needed`` is similar to no other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs_of(batches, "bucket"):
            name, key, count = (
                np.concatenate([np.frombuffer(x, kind) for x in part[c].to_pylist()])
                for c, kind in (("names", NAME), ("keys", np.uint64), ("counts", np.uint32))
            )
            order = np.lexsort((key, count, name["n"], name["b"], name["a"]))
            name, key = name[order], key[order]
            cuts = np.flatnonzero(np.r_[True, name[1:] != name[:-1], True])
            shared = np.diff(cuts)
            places = shared - needed(name["n"][cuts[:-1]].astype(np.int64)) + 1
            keep = np.arange(len(key)) - np.repeat(cuts[:-1], shared) < np.repeat(places, shared)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes() for x in name[keep]], pa.binary()), pa.array(key[keep].view(np.int64))],
                ["set_key", "shingle"],
            )

    return run


def _rare(packed: DataFrame, cells: int, needed: Callable[[np.ndarray], np.ndarray], ids: DataFrame) -> DataFrame:
    """Id and shingle of the rarest shared shingles of packed sets; ``ids`` has an id for each ``set_key``."""
    packed = packed.repartition(cells, "cell").sortWithinPartitions("cell")
    shared = packed.mapInArrow(_shared_counts(cells), "bucket int, names binary, keys binary, counts binary")
    dealt = shared.repartition(cells, "bucket").sortWithinPartitions("bucket")
    rarest = dealt.mapInArrow(_rarest(needed), "set_key binary, shingle bigint")
    return rarest.join(ids, "set_key").select("id", "shingle")


def _groups(rare: DataFrame) -> DataFrame:
    """``id`` and ``root`` of what is joined by shared shingles."""
    low = rare.groupBy("shingle").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1")
    groups = components(rare.join(low, "shingle").select(F.col("id").alias("a"), "b")).withColumnRenamed("node", "id")
    return groups.unionByName(groups.select("root").distinct().select(F.col("root").alias("id"), "root"))


def _chunked(members: DataFrame) -> DataFrame:
    """``members`` (id, n, set_key, root) with the chunk of each in its group, and the group's size."""
    weight = members.groupBy("root").agg(
        F.ceil(F.sum("n") / CHUNK).cast("bigint").alias("chunks"), F.count(F.lit(1)).alias("size")
    )
    apart = F.ceil(F.col("size") / HUBS)
    return members.join(weight, "root").select(
        "id", "n", "set_key", "root", "chunks", "size",
        F.pmod(F.xxhash64("id"), "chunks").alias("chunk"),
        ((F.col("chunks") > 1) & (F.pmod(F.xxhash64("id", F.lit(9)), apart) == 0)).alias("hub"),
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``(a, b)`` edges: node and the least node of its component.

    Alternating stars (Kiveris et al. 2014): every round links the larger neighbours of a node to
    its least neighbour, then the smaller ones, until nothing changes; rounds grow with the
    logarithm of the longest path. Each round is a written table.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                      F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        edges = stored(small)
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if last == tuple(mark):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = tuple(mark)


class Tree:
    """A signature tree over sets that are sorted by size: leaves first, then pairs of nodes."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, leaf: int = 8):
        self.levels = []  # bitmaps, least size, largest size, most shingles beyond the bits
        excess = sizes - np.bitwise_count(bits).sum(1, dtype=np.int64)
        at = np.arange(0, len(sizes), leaf)
        ends = np.minimum(at + leaf, len(sizes)) - 1
        self.leaf = leaf
        node = (np.bitwise_or.reduceat(bits, at, axis=0), sizes[at], sizes[ends], np.maximum.reduceat(excess, at))
        self.levels.append(node)
        while len(node[1]) > 1:
            at = np.arange(0, len(node[1]), 2)
            ends = np.minimum(at + 2, len(node[1])) - 1
            node = (np.bitwise_or.reduceat(node[0], at, axis=0), node[1][at], node[2][ends], np.maximum.reduceat(node[3], at))
            self.levels.append(node)

    def pairs(self, other: "Tree", percent: int) -> np.ndarray:
        """Leaf pairs that may hold a similar pair: a dual traversal from the roots down.

        Both nodes go down one level at a time. Two sets share at most as many shingles as their
        bitmaps share bits, and those that fell on a bit already taken. A pair of nodes stays if
        the ranges of the sizes and this largest overlap allow a similar pair.
        """
        deep = max(len(self.levels), len(other.levels))
        front = np.zeros((1, 2), np.int64)
        for down in range(deep - 1, -1, -1):
            a, b = (t.levels[min(down, len(t.levels) - 1)] for t in (self, other))
            i, j = front[:, 0], front[:, 1]
            # the smallest larger set and the largest smaller one
            keep = (100 * a[2][i] >= percent * b[1][j]) & (100 * b[2][j] >= percent * a[1][i])
            front = front[keep]
            i, j = front[:, 0], front[:, 1]
            both = np.zeros(len(front), np.int64)
            step = max(1, GATHER // a[0][:1].nbytes)
            for at in range(0, len(front), step):
                own = slice(at, at + step)
                both[own] = np.bitwise_count(a[0][i[own]] & b[0][j[own]]).sum(1, dtype=np.int64)
            need = np.maximum(least_shared(np.maximum(a[1][i], b[1][j]), percent), least_overlap(a[1][i], b[1][j], percent))
            front = front[both + np.minimum(a[3][i], b[3][j]) >= need]
            if down == 0:
                break
            grow = []
            for t, col in ((self, 0), (other, 1)):
                if down < len(t.levels):
                    n = len(t.levels[down - 1][1])
                    kids = np.stack([front[:, col] * 2, front[:, col] * 2 + 1], 1)
                    grow.append((kids, kids < n))
                else:
                    grow.append((front[:, [col]], np.ones((len(front), 1), bool)))
            (ka, oka), (kb, okb) = grow
            left = np.repeat(ka, kb.shape[1], 1).ravel()
            right = np.tile(kb, (1, ka.shape[1])).ravel()
            ok = (np.repeat(oka, kb.shape[1], 1) & np.tile(okb, (1, oka.shape[1]))).ravel()
            front = np.stack([left[ok], right[ok]], 1)
            if self is other:
                front = front[front[:, 0] <= front[:, 1]]
        return front


def _bitmap(sets: list[np.ndarray]) -> np.ndarray:
    """A signature of each set: as many bits, a power of two, as sets of the mean size need to differ."""
    mean = sum(map(len, sets)) // len(sets)
    bits = 1 << min(max((BITS * mean).bit_length(), 8), 16)
    out = np.zeros((len(sets), bits // 8), np.uint8)
    for i, s in enumerate(sets):
        hit = np.zeros(bits, np.uint8)
        hit[(s % U64(bits)).astype(np.int64)] = 1
        out[i] = np.packbits(hit)
    return out.view(np.uint64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def join_sets(sets: list[np.ndarray], label: np.ndarray, left: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join all similar sets of different labels, one of each pair being ``left``.

    A link that would join sets already joined is not looked for. Positions refer to ``sets``.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    own = [sets[i] for i in order]
    sizes = np.array([len(s) for s in own], np.int64)
    label, left, bits, links = label[order].copy(), left[order], _bitmap(own), []
    tree = Tree(bits, sizes)

    def test(i: int, j: int) -> None:
        if label[i] != label[j] and similar(own[i], own[j], percent):
            links.append((int(order[i]), int(order[j])))
            label[label == label[j]] = label[i]

    def candidates(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        need = least_overlap(sizes[i], sizes[j], percent)
        may = np.flatnonzero((left[i] | left[j]) & (label[i] != label[j]) & (np.minimum(sizes[i], sizes[j]) >= need))
        out = np.zeros(len(i), bool)
        i, j, need = i[may], j[may], need[may]
        only_i = np.bitwise_count(bits[i] & ~bits[j]).sum(1, dtype=np.int64)
        only_j = np.bitwise_count(bits[j] & ~bits[i]).sum(1, dtype=np.int64)
        out[may] = np.minimum(sizes[i] - only_i, sizes[j] - only_j) >= need
        return out

    middle = np.full(len(own), len(own) // 2)
    for i in np.flatnonzero(candidates(np.arange(len(own)), middle)):
        test(int(middle[0]), int(i))  # most copies are near to one of middle size
    spread = np.arange(tree.leaf)
    pairs = tree.pairs(tree, percent)
    step = min(1024, max(1, GATHER // (tree.leaf * tree.leaf * bits[:1].nbytes)))
    for at in range(0, len(pairs), step):
        a, b = pairs[at : at + step, :1], pairs[at : at + step, 1:]
        i = np.repeat(a * tree.leaf + spread, tree.leaf, 1).ravel()
        j = np.tile(b * tree.leaf + spread, (1, tree.leaf)).ravel()
        ok = np.flatnonzero((i < j) & (j < len(own)))
        ok = ok[label[i[ok]] != label[j[ok]]]
        i, j = i[ok], j[ok]
        ok = candidates(i, j)
        for x, y in zip(i[ok], j[ok]):
            test(int(x), int(y))
    return links


def _join_jobs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs_of(batches, "job"):
            ids = np.asarray(part["id"])
            if len(ids) < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in part["keys"].to_pylist()]
            links = join_sets(sets, np.asarray(part["label"]), np.asarray(part["left"]), percent)
            a, b = ids[[i for i, _ in links]], ids[[j for _, j in links]]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _loaded(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """The sets of the members of groups, from the texts."""

    names = ["root", "chunk", "chunks", "size", "hub", "id", "n", "set_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(Words(part["text"]), n)
                # a repeated id may have several texts: only the one that was meant
                own = np.array([_set_key(s) == k for s, k in zip(sets, part["set_key"].to_pylist())], bool)
                kept = part.filter(pa.array(own))
                keys = pa.array([s.tobytes() for s, ok in zip(sets, own) if ok], pa.binary())
                yield pa.RecordBatch.from_arrays([*(kept[c] for c in names), keys], [*names, "keys"])

    texts = _plain(docs).withColumnRenamed("doc_id", "id")
    if members.count() <= NEAR:
        texts = texts.join(F.broadcast(members.select("id")), "id", "left_semi")
    texts = texts.join(members, "id")
    return texts.mapInArrow(run, texts.select(*names).schema.add("keys", "binary"))


def _regrouped(wide: DataFrame, percent: int) -> DataFrame:
    """The loaded sets of wide groups in new groups, by all their shingles; what is similar to none is left out."""
    cells = max(1, -(-wide.agg(F.sum("n")).first()[0] // CHUNK))
    known = wide.select("id", "n", "set_key").distinct()  # a repeated row is loaded each time
    rare = stored(_rare(whole_cells(wide, cells), cells, lambda size: least_shared(size, percent), known))
    members = _chunked(_groups(rare).join(known, "id"))
    return wide.select("id", "set_key", "keys").join(members, ["id", "set_key"]).select(wide.columns)


def _dealt(jobs: DataFrame, percent: int) -> DataFrame:
    return jobs.repartition("job").sortWithinPartitions("job").mapInArrow(_join_jobs(percent), "a bigint, b bigint")


def _all_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links that connect what is similar within each group.

    A group of one chunk is one job. In a larger one every chunk also meets the hubs; then the
    documents outside the group's largest component meet every chunk, in pieces. Two documents of
    the largest component need no further link, so nothing is missed.
    """
    columns = ["id", "keys", "label", "left"]
    meets = F.when(F.col("hub"), F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    first = sets.select("*", F.explode(meets).alias("at")).select(
        F.xxhash64("root", "at").alias("job"), F.col("id").alias("label"), F.lit(True).alias("left"), "id", "keys"
    )
    links = stored(_dealt(first.select("job", *columns), percent))
    large = sets.where("chunks > 1")
    if large.isEmpty():
        return links
    labels = components(links)
    large = stored(
        large.join(labels.select(F.col("node").alias("id"), F.col("root").alias("label")), "id", "left")
        .withColumn("label", F.coalesce("label", "id"))
    )
    main = (
        large.groupBy("root", "label").count().groupBy("root").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    )
    rest = large.join(main, "root").where("label <> main").drop("main")
    pieces = rest.groupBy("root").agg(F.ceil(F.sum("n") / CHUNK).cast("bigint").alias("pieces"))
    zero = F.lit(0).cast("bigint")
    lefts = rest.join(pieces, "root").withColumn("piece", F.pmod(F.xxhash64("id", F.lit(5)), "pieces")).select(
        "*", F.explode(F.sequence(zero, F.col("chunks") - 1)).alias("at")
    )
    rights = large.join(pieces, "root").select("*", F.explode(F.sequence(zero, F.col("pieces") - 1)).alias("piece"))
    job = lambda at: F.xxhash64("root", "piece", at).alias("job")
    more = lefts.select(job("at"), "id", "keys", "label", F.lit(True).alias("left")).unionByName(
        rights.select(job("chunk"), "id", "keys", "label", F.lit(False).alias("left"))
    )
    return links.unionByName(_dealt(more, percent))


def similar_documents(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id reachable by links of similar sets.

    Exact but for hash ties: shingles are 64-bit hashes, sets 96-bit ones with their size. Documents with equal sets
    are one class; only classes are compared. A text without words has no set and no link. Rows
    with a null id are linked with nothing; repeated rows are answered each. Other columns are
    ignored.
    """
    return _classed(docs, n, percent).drop("set_key")


def _classed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``similar_documents`` with ``set_key``, equal for equal sets (null without a set)."""
    cells = parts_for(docs, CELL)
    info = stored(set_rows(docs, n))
    classes = stored(
        info.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")).where("doc_id is not null")
    )
    ids = classes.withColumnRenamed("doc_id", "id")
    rare = stored(_rare(prefix_cells(docs, n, percent, cells), cells, lambda size: _needed(size, percent), ids))
    sets = stored(_loaded(docs, stored(_chunked(_groups(rare).join(ids, "id"))), n))
    wide = sets.where((F.col("chunks") > 1) | (F.col("size") > WIDE))
    if not wide.isEmpty():
        sets = sets.where((F.col("chunks") <= 1) & (F.col("size") <= WIDE)).unionByName(stored(_regrouped(wide, percent)))
    joined = components(_all_links(sets, percent)).select(F.col("node").alias("least"), F.col("root").alias("component_id"))
    named = classes.select("set_key", F.col("doc_id").alias("least")).join(joined, "least", "left")
    named = named.select("set_key", F.coalesce("component_id", "least").alias("component_id"))
    return info.join(named, "set_key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("set_key")).alias("set_key"),
    )


def one_of_each(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """Of each group of similar documents the row with the least doc_id; other rows stay.

    A row is known by its doc_id and its set: an id with a copy and a clean text loses the copy alone.
    Of rows with the least id of their group one stays for each set, with the least text: a repeated
    row stays once. Two texts are linked, too, by an id that is the least of both. Rows without
    words, or with a null id, all stay.
    Columns may have any name.
    """
    rows, new = numbered(docs)
    own_id = F.col(new["doc_id"]).cast("bigint") == F.col("doc_id")
    with passing() as made:
        every = stored(_classed(docs, n, percent).where("doc_id is not null"))
        made.pop()  # the classes themselves are read further
    found = every.where("set_key is not null")
    seen = found.groupBy("doc_id", "set_key", (F.col("component_id") == F.col("doc_id")).alias("stays")).count()
    sized = stored(seen.where("not stays or count > 1"))
    several = every.groupBy("doc_id").count().where("count > 1")  # ids of more than one row
    mixed = stored(sized.join(several.select("doc_id"), "doc_id", "left_semi"))
    sure = sized.join(several.select("doc_id"), "doc_id", "left_anti").select("doc_id")
    rest = rows.join(sure, own_id, "left_anti")
    if mixed.isEmpty():
        return rest.toDF(*docs.columns)
    # rows of repeated ids are read again for their sets
    ids = mixed.select("doc_id").distinct()
    keyed = _with_set_key(rest.join(ids, own_id, "left_semi"), new, n)
    single = keyed.join(mixed.where("not stays").select("doc_id", "set_key"), ["doc_id", "set_key"], "left_anti")
    twice = mixed.where("stays").select("doc_id", "set_key")
    row = F.struct(*new.values())
    again = single.join(twice, ["doc_id", "set_key"], "left_semi").groupBy("doc_id", "set_key").agg(
        F.min_by(row, F.struct(F.col(new["text"]).cast("string"), F.to_json(row))).alias("row")
    )
    single = single.join(twice, ["doc_id", "set_key"], "left_anti").select(*new.values())
    out = rest.join(ids, own_id, "left_anti").unionByName(single).unionByName(again.select("row.*"))
    return out.toDF(*docs.columns)


def _with_set_key(rows: DataFrame, new: dict[str, str], n: int) -> DataFrame:
    """``rows`` with ``doc_id`` as a long and ``set_key``; one row a set is made of (empty: null key)."""
    names = list(new.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(Words(part["text"]), n)
                keys = pa.array([_set_key(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part[c] for c in [*names, "doc_id"]), keys], [*names, "doc_id", "set_key"])

    doc_id, text = F.col(new["doc_id"]).cast("bigint").alias("doc_id"), F.col(new["text"]).cast("string").alias("text")
    plain = rows.select(*names, doc_id, text)
    return plain.mapInArrow(run, plain.select(*names, "doc_id").schema.add("set_key", "binary"))


def op7_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))
