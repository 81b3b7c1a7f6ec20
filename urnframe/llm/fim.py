"""Fill-in-middle transformation by secondary sort.

A document becomes pieces of bounded length, keyed by its row and their place in the output. One
shuffle by row with a sort by place (the DataFrame form of repartition-and-sort-within-partitions)
streams the pieces of every output in order, into an incremental digest. The output's own sentinels
tell the sections again; a second sort, inside the same partitions, streams the restored text. No
text is ever put together in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urnframe.llm.store import parts_for, table

SEED = 1
PLAIN_FROM, SPM_BELOW = 90, 20  # percent
CHUNK = 1 << 16  # code points of a piece at most
PART = 16 << 20  # bytes of input files for each partition of pieces
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}  # of the sections in the text
PIECES = "slot bigint, at bigint, doc_id bigint, form string, n bigint, prefix_chars bigint, middle_chars bigint, piece string"
RESTORED = (
    "slot bigint, section int, at bigint, doc_id bigint, form string, n bigint, prefix_chars bigint, middle_chars bigint,"
    " piece string, output_sha256 string"
)
RESULT = (
    "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"
)


def cuts_of(doc_id: int | None, text: str, seed: int = SEED) -> tuple[str, int, int]:
    """The form of a document's output and where its prefix and middle end, from a hash of its id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    low, high = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or h[2] % 100 >= PLAIN_FROM or any(mark in text for mark in PLACE):
        return "plain", low, high
    return ("spm" if h[3] % 100 < SPM_BELOW else "psm"), low, high


def pieces(docs: DataFrame, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """The output of every row in pieces, in the order of the text: ``at`` is the place in the output.

    Rows are numbered by task and place in it (``slot``), so repeated rows and null ids stay apart.
    """

    def sections(form: str, text: str, low: int, high: int) -> list[tuple[int, int, int, str]]:
        """Start and end in the text, place in the output, and the sentinel in front."""
        if form == "plain":
            return [(0, len(text), 0, "")]
        ranges = {PREFIX: (0, low), MIDDLE: (low, high), SUFFIX: (high, len(text))}
        out, at = [], 0
        for mark in ORDER[form]:
            a, b = ranges[mark]
            out.append((a, b, at, mark))
            at += b - a + len(mark)
        return sorted(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId() << 40
        names = ["slot", "at", "doc_id", "form", "n", "prefix_chars", "middle_chars", "piece"]
        kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 3 + [pa.string()]
        rows, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                doc_id, text = doc_id.as_py(), text.as_py() or ""
                form, low, high = cuts_of(doc_id, text, seed)
                own = (doc_id, form, len(text), *((None, None) if form == "plain" else (low, high - low)))
                for a, b, at, mark in sections(form, text, low, high):
                    for k in range(a, max(b, a + 1), chunk):
                        piece = text[k : min(b, k + chunk)]
                        rows.append((slot, at + (k - a) + (len(mark) if k > a else 0), *own, (mark if k == a else "") + piece))
                        size += len(piece) + 100
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                            rows, size = [], 0
                slot += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, PIECES)


class Parser:
    """Cuts a streamed output at its sentinels, wherever the pieces end."""

    def __init__(self, form: str):
        self.marks = list(ORDER.get(form, ()))
        self.section, self.rest, self.waits = (-1 if self.marks else 0), "", 0

    def add(self, piece: str) -> list[tuple[int, str]]:
        """Sections and texts that are certain now."""
        out, text = [], self.rest + piece
        while self.marks:
            at = text.find(self.marks[0])
            if at < 0:
                break
            if at and self.section >= 0:
                out.append((self.section, text[:at]))
            text = text[at + len(self.marks[0]) :]
            self.section = PLACE[self.marks.pop(0)]
        keep = min(len(text), 2) if self.marks else 0  # may be the beginning of a sentinel
        if len(text) > keep:
            out.append((self.section, text[: len(text) - keep]))
        self.rest = text[len(text) - keep :]
        return out


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of outputs in order; the pieces again, by section. A row's last piece has the digest."""
    names = ["slot", "section", "at", "doc_id", "form", "n", "prefix_chars", "middle_chars", "piece", "output_sha256"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 3, pa.string(), pa.string()]
    slot = own = digest = parser = None
    rows, size = [], 0

    def finish() -> None:
        rows.append((slot, 3, at, *own, "", digest.hexdigest()))  # sorts last

    at = 0
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("slot", "doc_id", "form", "n", "prefix_chars", "middle_chars", "piece")]
        for number, *values, piece in zip(*columns):
            if number != slot:
                if slot is not None:
                    finish()
                slot, own, at = number, values, 0
                digest, parser = hashlib.sha256(), Parser(values[1])
            digest.update(piece.encode())
            for section, text in parser.add(piece):
                rows.append((slot, section, at, *own, text, None))
                at, size = at + 1, size + len(text) + 200
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
            rows, size = [], 0
    if slot is not None:
        finish()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document row, with the digest of its restored text."""
    digest = hashlib.sha256()
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        columns = [batch[c].to_pylist() for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "piece")]
        for *values, output, piece in zip(*columns):
            if output is None:
                digest.update(piece.encode())
            else:
                rows.append((*values, output, digest.hexdigest()))
                digest = hashlib.sha256()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def assembled(docs: DataFrame, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """The pieces of all outputs, those of a row in one partition and in order: the real outputs.

    Columns ``slot``, ``at`` and ``piece`` say which row, where, and what.
    """
    parts = parts_for(docs, PART)
    return pieces(docs, seed, chunk).repartition(parts, "slot").sortWithinPartitions("slot", "at")


def fill_in_middle(docs: DataFrame, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every row.

    A null text is empty, and an empty one plain. A null id hashes as no digits. Repeated rows are
    answered each. ``prefix_chars`` and ``middle_chars`` are null for plain outputs. A text that
    holds a sentinel is plain, so an output's sentinels are its own. Other columns are ignored.
    """
    streamed = assembled(docs, seed, chunk).mapInArrow(_assembled, RESTORED)
    return streamed.sortWithinPartitions("slot", "section", "at").mapInArrow(_restored, RESULT)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"))
