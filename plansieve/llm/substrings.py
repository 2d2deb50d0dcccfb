"""Substring de-duplication with a count-min prefilter.

A window is ``width`` consecutive words of one document. First every partition sketches which windows it has, the
sketches are summed, and only cells counted twice or more are kept, as a bitmap of fixed size. The sketch has ``ROWS`` rows of cells with
hashes of their own; a row takes in what the rows before it have not ruled out. Then a window that some row counted once stands in
one document only and is settled; the others are grouped exactly. A cell counts at least what any window in it counts, so no repeated
window is lost, whatever the bitmaps' size; bitmaps that are too small for the corpus only send more windows to the exact grouping.

What is counted for a window is its *rarest gram*: the smallest hash among its runs of ``GRAM`` words. Equal windows have
equal ones, neighbouring windows mostly share them, so the sketch takes in a fifth of the windows.

In the exact grouping a task first settles what it can see itself: of the equal windows in a batch of documents only the smallest
doc_id's is asked about, the others are repeats already. So a passage that a third of all documents share is one row per batch
in the shuffle, not one per document. Windows are grouped by two independent 64-bit hashes.

Defined results: a null text has no words and keeps the empty text; documents shorter than a window keep all their words; a
doc_id that repeats is not smaller than itself, so such rows do not remove each other's words; a null doc_id is larger than
all others; an empty table gives an empty table; further columns are ignored, or carried along by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plansieve.llm.common import table, text_of
from plansieve.llm.hashes import MIX, MIX2, mixed, run_hashes, word_hashes, word_slices
from plansieve.operators.narrow import stash

WIDTH = 13
GRAM = 5
ROWS = 2
CELL_BITS = 28  # a row's bitmap has 2 ** CELL_BITS bits, 32 MB in a worker
BLOCK_BITS = 20
ANSWER_BITS = 32
class Windows:
    """The windows of some documents: of each its document's number, its start there, its rarest gram and its hash."""

    def __init__(self, words: list[list[bytes]], width: int, gram: int):
        flat, sizes = word_hashes(words)
        first = np.cumsum(sizes) - sizes
        count = np.maximum(sizes - width + 1, 0)
        self.doc = np.repeat(np.arange(len(words)), count)
        self.start = np.arange(len(self.doc)) - np.repeat(np.cumsum(count) - count, count)
        at = self.start + np.repeat(first, count)
        if not len(at):
            self.rare = self.hash = np.zeros(0, np.uint64)
            return
        grams = run_hashes(flat, gram, MIX)
        m = len(flat) - width + 1
        rare = grams[:m].copy()
        for k in range(1, width - gram + 1):
            np.minimum(rare, grams[k : k + m], out=rare)
        self.rare, self.hash = rare[at], run_hashes(flat, width, MIX2)[at]

    def cells(self, row: int) -> np.ndarray:
        # Small hashes crowd at the low end: mix them before taking the top bits.
        return (mixed((self.rare + np.uint64(row)) * MIX) >> np.uint64(64 - CELL_BITS)).astype(np.int64)

    def maybe_repeated(self, bitmaps: list[np.ndarray]) -> np.ndarray:
        """Whether every row so far has counted the window twice or more."""
        maybe = np.ones(len(self.rare), bool)
        for row, bitmap in enumerate(bitmaps):
            cells = self.cells(row)
            maybe &= (bitmap[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)
        return maybe


# --- the sketch ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Row:
    """A row of the sketch: its bitmap of repeated cells, broadcast as compressed blocks."""

    name: str
    blocks: Broadcast

    def bitmap(self) -> np.ndarray:
        """Unpacked once per worker; only the rows of the latest sketches are kept."""
        if self.name not in _bitmaps:
            while len(_bitmaps) >= ROWS:
                _bitmaps.pop(next(iter(_bitmaps)))
            bitmap = np.zeros(1 << (CELL_BITS - 3), np.uint8)
            size = 1 << (BLOCK_BITS - 3)
            for block, packed in self.blocks.value.items():
                bitmap[block * size : (block + 1) * size] = np.frombuffer(zlib.decompress(packed), np.uint8)
            _bitmaps[self.name] = bitmap
        return _bitmaps[self.name]


_bitmaps: dict[str, np.ndarray] = {}


def count_row(docs: DataFrame, width: int, gram: int, before: list[Row]) -> Row:
    """The cells of the next row that are counted twice or more."""
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int32())])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in word_slices(batches):
            w = Windows(words, width, gram)
            some = np.flatnonzero(w.maybe_repeated([r.bitmap() for r in before]))
            cells, doc = w.cells(len(before))[some], w.doc[some]
            new = np.ones(len(cells), bool)
            # Neighbouring windows of a document with one rarest gram count once.
            new[1:] = (cells[1:] != cells[:-1]) | (doc[1:] != doc[:-1])
            cell, n = np.unique(cells[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(n, pa.int32())], schema=schema)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Cells come in order: one block is open at a time.
        bits, open_block = np.zeros(1 << BLOCK_BITS, bool), None

        def closed() -> pa.RecordBatch:
            packed = zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)
            bits[:] = False
            return pa.RecordBatch.from_arrays([pa.array([open_block], pa.int32()), pa.array([packed], pa.binary())], names=["block", "bits"])

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            for block in np.unique(cells >> BLOCK_BITS).tolist():
                if open_block not in (None, block):
                    yield closed()
                open_block = block
                bits[cells[cells >> BLOCK_BITS == block] & ((1 << BLOCK_BITS) - 1)] = True
        if open_block is not None:
            yield closed()

    counted = docs.select("text").mapInArrow(sketch, "cell int, n int").groupBy("cell").agg(F.sum("n").alias("n"))
    # A task has the blocks of its own cells only; there are at most 2 ** (CELL_BITS - BLOCK_BITS) of them.
    by_block = counted.where("n > 1").select("cell").repartition(F.shiftright("cell", BLOCK_BITS)).sortWithinPartitions("cell")
    found = {r["block"]: bytes(r["bits"]) for r in by_block.mapInArrow(blocks, "block int, bits binary").collect()}
    return Row(uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(found))


# --- exact grouping ---------------------------------------------------------------------------------------

_STATE = (
    "row_id long, doc_id long, n_words long, kept_sha256 string, packed_text binary, repeats array<int>,"
    " runs array<struct<start:int,rare:long,hashes:array<long>>>"
)
_RUN_ARROW = pa.struct([("start", pa.int32()), ("rare", pa.int64()), ("hashes", pa.list_(pa.int64()))])


def _listed(values: pa.Array, owner: np.ndarray, n_owners: int) -> pa.Array:
    """``values``, ordered by owner, as one list per owner."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n_owners + 1)).astype(np.int32)), values)


def _runs_of(doc: np.ndarray, start: np.ndarray, rare: np.ndarray, hashed: np.ndarray, n_docs: int) -> pa.Array:
    """Windows, ordered by document and start, as runs: neighbours with one rarest gram share a row in the shuffle."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (rare[1:] != rare[:-1])
    # No run is longer than an answer has bits.
    at = np.arange(len(doc))
    new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % ANSWER_BITS == 0
    run = np.cumsum(new) - 1
    hashes = _listed(pa.array(hashed.view(np.int64)), run, int(new.sum()))
    runs = pa.StructArray.from_arrays(
        [pa.array(start[new].astype(np.int32)), pa.array(rare[new].view(np.int64)), hashes], fields=list(_RUN_ARROW)
    )
    return _listed(runs, doc[new], n_docs)


def _settle(docs: DataFrame, width: int, gram: int, carried: list[str]) -> DataFrame:
    """One row per document: what its task settled itself and what it has to ask the others."""
    rows: list[Row] = []
    for _ in range(ROWS):
        rows.append(count_row(docs, width, gram, rows))
    whole = bool(carried)
    last = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        row_id = TaskContext.get().partitionId() << 40
        for batch, words in word_slices(batches):
            n = len(words)
            w = Windows(words, width, gram)
            asked = np.flatnonzero(w.maybe_repeated([r.bitmap() for r in rows]))
            doc, start, rare, hashed = w.doc[asked], w.start[asked], w.rare[asked], w.hash[asked]
            doc_id = np.array([last if x is None else x for x in batch.column("doc_id").to_pylist()], np.int64)
            # Of equal windows here, all but those of the smallest doc_id are repeats.
            order = np.lexsort((doc_id[doc], hashed, rare))
            new = np.ones(len(order), bool)
            new[1:] = (rare[order][1:] != rare[order][:-1]) | (hashed[order][1:] != hashed[order][:-1])
            smallest = doc_id[doc[order]][new][np.cumsum(new) - 1] if len(order) else doc_id[:0]
            repeat = np.zeros(len(order), bool)
            repeat[order] = doc_id[doc[order]] > smallest
            with_any = np.bincount(doc, minlength=n) > 0
            shas = [None if a else hashlib.sha256(b" ".join(ws)).hexdigest() for a, ws in zip(with_any, words)]
            # Where whole rows are carried, the text is in them.
            packer = zstandard.ZstdCompressor(level=3)
            packed = [packer.compress(t.as_py().encode("utf-8", "surrogatepass")) if a and not whole else None for a, t in zip(with_any, batch.column("text"))]
            columns = [
                pa.array(np.arange(row_id, row_id + n)),
                batch.column("doc_id"),
                pa.array(np.fromiter(map(len, words), np.int64, n)),
                pa.array(shas, pa.string()),
                pa.array(packed, pa.binary()),
                _listed(pa.array(start[repeat].astype(np.int32)), doc[repeat], n),
                _runs_of(doc[~repeat], start[~repeat], rare[~repeat], hashed[~repeat], n),
            ]
            row_id += n
            names = ["row_id", "doc_id", "n_words", "kept_sha256", "packed_text", "repeats", "runs", *carried]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(c) for c in carried], names=names)

    kinds = T.StructType.fromDDL(_STATE)
    for c in carried:
        kinds.add(c, docs.schema[c].dataType)
    return docs.select("doc_id", "text", *carried).mapInArrow(run, kinds)


def find_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, carried: list[str] | None = None) -> DataFrame:
    """The settled state of every document with ``more``: windows that repeat those of other tasks' documents.

    ``more`` lists runs: a start, and a bit for each window from there on.

    ``docs`` has doc_id and text (never null) and the ``carried`` columns.
    """
    state = stash(_settle(docs, width, gram, carried or []), "substrings")
    # Dealt by rarest gram, a run travels as one row and is unfolded where it arrives.
    runs = state.where(F.size("runs") > 0).select(
        "row_id", F.coalesce("doc_id", F.lit(int(np.iinfo(np.int64).max))).alias("rank"), F.inline("runs")
    )
    asked = runs.repartition("rare").select("row_id", "rank", "start", "rare", F.posexplode("hashes").alias("nth", "hash"))
    same = Window.partitionBy("rare", "hash")
    # A run lies in one partition, so its answers become one number before they travel back.
    answered = (
        asked.withColumn("smallest", F.min("rank").over(same))
        .where("rank > smallest")
        .groupBy("rare", "row_id", "start")
        .agg(F.bit_or(F.expr("shiftleft(1L, nth)")).alias("mask"))
        .groupBy("row_id")
        .agg(F.collect_list(F.struct("start", "mask")).alias("more"))
    )
    return state.drop("runs").join(answered, "row_id", "left")


def covered_words(n_words: int, width: int, repeats: pa.ListScalar, more: pa.ListScalar) -> np.ndarray:
    """Which words the repeated windows cover."""
    edges = np.zeros(n_words + 1, np.int64)
    starts = [repeats.values.to_numpy()] if repeats.is_valid else []
    if more.is_valid:
        start, mask = (more.values.field(k).to_numpy() for k in ("start", "mask"))
        run, nth = np.nonzero(mask[:, None] >> np.arange(ANSWER_BITS) & 1)
        starts.append(start[run] + nth)
    for at in starts:
        np.add.at(edges, at, 1)
        np.add.at(edges, at + width, -1)
    return np.cumsum(edges)[:n_words] > 0


def report(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            import zstandard

            removed, shas = [], []
            for packed, sha, repeats, more in zip(*(batch.column(c) for c in ("packed_text", "kept_sha256", "repeats", "more"))):
                if sha.is_valid:
                    removed.append(0)
                    shas.append(sha.as_py())
                    continue
                words = zstandard.decompress(packed.as_py()).split()
                gone = covered_words(len(words), width, repeats, more)
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone) if not g])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], schema=schema)

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text"))
    return find_repeats(wanted, width).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_words(text: str, gone: np.ndarray) -> str:
    """The text without those words; what stood between two kept words stays, cuts leave one space."""
    parts, was_gone = [], False
    for k, m in enumerate(re.finditer("[ \t-\r]*[^ \t-\r]+", text)):
        if not gone[k]:
            parts.append(" " * bool(parts) + m[0].lstrip(" \t\n\v\f\r") if was_gone else m[0])
        was_gone = bool(gone[k])
    return "".join(parts)


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without repeated windows, other columns as they were; a document of which nothing is left goes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text"), F.struct("*").alias("row"))
    kinds = T.StructType().add("row", rows.schema["row"].dataType).add("cut", T.BooleanType()).add("left", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cut = [], []
            columns = [batch.column("row").field("text"), *(batch.column(c) for c in ("n_words", "kept_sha256", "repeats", "more"))]
            for text, n, sha, repeats, more in zip(*columns):
                gone = covered_words(n.as_py(), width, repeats, more) if not sha.is_valid else None
                changed = gone is not None and bool(gone.any())
                cut.append(changed)
                texts.append((None if gone.all() else cut_words(text.as_py(), gone)) if changed else None)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(cut, pa.bool_()), pa.array(texts, pa.string())], names=["row", "cut", "left"])

    found = find_repeats(rows, width, carried=["row"]).mapInArrow(run, kinds)
    text = F.when(F.col("cut"), F.col("left")).otherwise(F.col("row.text"))
    return found.where("not cut or left is not null").select(F.col("row").withField("text", text).alias("row")).select("row.*")


# --- query ---------------------------------------------------------------------------------------------


def op7_substring_dedup(spark, sf_dir):
    return report(table(spark, sf_dir, "documents"))
