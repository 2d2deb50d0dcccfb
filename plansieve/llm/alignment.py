"""Aligning the tokens of two tokenizers by the bytes they cover.

Each tokenizer's tokens of a text are rows of a sparse token-byte incidence matrix, kept as CSR arrays that are built here from
the tokens' byte lengths. The product A·Bᵀ, row by row after Gustavson, tells how many bytes a token of A and a token of B
share: the overlap links. Overlapping tokens that end together are the links of equal ends; the bytes where they end cut a text
into groups. The incidence of tokens in groups is a second pair of matrices, whose product links all tokens of a group.

Matrices are built for a window of a text at a time, cut where both tokenizers end a token, so their size does not depend on the
text's length. What is counted over the corpus is the linked pair of ids: each task adds up its own, the sums are shuffled. To look a
pair's count up again, at most ``frequent`` of the most frequent pairs are broadcast (a histogram of the counts finds them), and all
other pairs are joined by shuffle; none of those is frequent enough to be a hot key. Between the steps stands a written table with
each document's distinct pairs, so texts are encoded once.

Defined results: a null or empty text, and one whose tokens of either side do not spell the text with a space before it, has
no tokens (zeros and an empty digest); a null doc_id stays null; repeated rows each get their own equal row and count as often as
they stand; very long texts are aligned whole; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansieve.llm.common import table, text_of
from plansieve.llm.packing import Encoder, _byte_letters
from plansieve.operators.narrow import stash

WINDOW_BYTES = 1 << 20
PRODUCT_TERMS = 1 << 22
SLICE_TOKENS = 300_000
FREQUENT_PAIRS = 1 << 18  # 17 bytes each
COUNTED_PAIRS = 1 << 20  # a task hands on its counts when it has so many pairs
REMEMBERED_CHUNKS = 400_000
REMEMBERED_LENGTH = 64
ID_BITS = 20


# --- sparse matrices -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Csr:
    """Row r holds the columns ``indices[indptr[r] : indptr[r + 1]]`` with the values at the same places of ``data``."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    n_columns: int

    @classmethod
    def runs(cls, ends: np.ndarray, first: int = 0) -> Csr:
        """Row r covers the columns from the end of row r - 1 up to its own end: tokens by the bytes they cover."""
        indptr = np.concatenate([[0], ends - first])
        n = int(indptr[-1])
        return cls(indptr, np.arange(n), np.ones(n, np.int64), n)

    @classmethod
    def members(cls, group: np.ndarray, n_groups: int) -> Csr:
        """Row r has a single entry, in the column of its group."""
        return cls(np.arange(len(group) + 1), group, np.ones(len(group), np.int64), n_groups)

    @property
    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        order = np.argsort(self.indices, kind="stable")
        indptr = np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=self.n_columns))])
        return Csr(indptr, rows[order], self.data[order], len(self.indptr) - 1)


def product(a: Csr, b: Csr, most: int = PRODUCT_TERMS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, value) of a·b, row by row: each entry of a row of ``a`` adds a multiple of a row of ``b``.

    Rows come in blocks of at most ``most`` terms (or one row), which bounds the memory.
    """
    taken = np.diff(b.indptr)[a.indices]
    before = np.concatenate([[0], np.cumsum(taken)])
    at_row, n_rows, r0 = before[a.indptr], len(a.indptr) - 1, 0
    while r0 < n_rows:
        r1 = max(r0 + 1, int(np.searchsorted(at_row, at_row[r0] + most, "right")) - 1)
        entries = slice(a.indptr[r0], a.indptr[r1])
        times, n_terms = taken[entries], int(at_row[r1] - at_row[r0])
        rows = np.repeat(np.repeat(np.arange(r0, r1), np.diff(a.indptr[r0 : r1 + 1])), times)
        places = np.repeat(b.indptr[a.indices[entries]] - (before[entries] - at_row[r0]), times) + np.arange(n_terms)
        key = rows * b.n_columns + b.indices[places]
        values = np.repeat(a.data[entries], times) * b.data[places]
        if np.any(key[1:] < key[:-1]):
            order = np.argsort(key, kind="stable")
            key, values = key[order], values[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n_terms else np.empty(0, np.int64)
        if n_terms:
            yield key[first] // b.n_columns, key[first] % b.n_columns, np.add.reduceat(values, first)
        r0 = r1


# --- links ---------------------------------------------------------------------------------------------


def windows(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of tokens (of A, of B) that cover the same bytes, some ``size`` bytes or up to the next common end."""
    a0 = b0 = begin = 0
    while a0 < len(ends_a):
        k = min(int(np.searchsorted(ends_a, begin + size)), len(ends_a) - 1)
        while True:
            block = ends_a[k : k + 1024]
            shared = ends_b[np.searchsorted(ends_b, block)] == block
            if shared.any():
                break
            k += len(block)
        a1 = k + int(np.argmax(shared)) + 1
        b1 = int(np.searchsorted(ends_b, ends_a[a1 - 1])) + 1
        yield a0, a1, b0, b1
        a0, b0, begin = a1, b1, int(ends_a[a1 - 1])


def overlap_links(ends_a: np.ndarray, ends_b: np.ndarray, size: int = WINDOW_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(token of A, token of B, bytes they share) of all overlapping tokens, from the ends of tokens that cover the same text."""
    for a0, a1, b0, b1 in windows(ends_a, ends_b, size):
        first = int(ends_a[a0 - 1]) if a0 else 0
        by_byte = Csr.runs(ends_b[b0:b1], first).transposed
        for i, j, n in product(Csr.runs(ends_a[a0:a1], first), by_byte):
            yield i + a0, j + b0, n


def end_links(ends_a: np.ndarray, ends_b: np.ndarray, size: int = WINDOW_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(token of A, token of B) of the overlapping tokens that end together."""
    found = [(i[same], j[same]) for i, j, _ in overlap_links(ends_a, ends_b, size) for same in [ends_a[i] == ends_b[j]]]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *(i for i, _ in found)]), np.concatenate([none, *(j for _, j in found)])


def groups_of(n_tokens: int, closing: np.ndarray) -> np.ndarray:
    """Each token's group; ``closing`` are the tokens that end one."""
    group = np.zeros(n_tokens + 1, np.int64)
    group[closing + 1] = 1
    return np.cumsum(group)[:-1]


def group_links(ends_a: np.ndarray, ends_b: np.ndarray, size: int = WINDOW_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(token of A, token of B, 1) of all tokens that share a group, from the product of the group incidences."""
    i, j = end_links(ends_a, ends_b, size)
    a, b = (Csr.members(groups_of(len(ends), closing), len(i)) for ends, closing in ((ends_a, i), (ends_b, j)))
    yield from product(a, b.transposed)


# --- the two tokenizers --------------------------------------------------------------------------------


class ByteLevel:
    """Side A: a byte-level vocabulary of the tokenizers library; the strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        self.encoder.whole.encode_special_tokens = True
        self.encoder.special = None
        letters = _byte_letters()
        special = {t.content for t in self.encoder.whole.get_added_tokens_decoder().values()}
        vocabulary = {i: token for token, i in self.encoder.whole.get_vocab(with_added_tokens=True).items()}
        self.bytes = [
            b"" if vocabulary.get(i, "") in special else bytes(letters[c] for c in vocabulary.get(i, "")) for i in range(max(vocabulary) + 1)
        ]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encoder.encode(" " + text), "<u4").astype(np.int64)


class SpacedPieces(dict):
    """Side B: a sentencepiece vocabulary that puts a space before the text itself.

    No piece goes on from another character to a space, so a run of spaces and what follows it up to the next space is
    encoded by itself, and remembered. For a vocabulary of which that is not true, whole texts are encoded.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        rules = model.normalizer_spec
        kinds = model.SentencePiece
        by_chunk = (
            not rules.precompiled_charsmap
            and rules.add_dummy_prefix
            and rules.escape_whitespaces
            and not rules.remove_extra_whitespaces
            and model.trainer_spec.model_type == model.trainer_spec.BPE
            and not any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) or "▁" in p.piece.lstrip("▁") for p in model.pieces)
        )
        self.chunks = re.compile(" +[^ ]*" if by_chunk else r"(?s).+").findall
        self.space = self.pieces.piece_to_id("▁")
        self.bytes = [
            bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE
            else b"" if p.type in (kinds.CONTROL, kinds.UNKNOWN)
            else p.piece.replace("▁", " ").encode()
            for p in model.pieces
        ]

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.pieces.encode(chunk[1:]) if len(chunk) > 1 else [self.space], "<u4").tobytes()
        if len(chunk) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED_CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.chunks(" " + text))), "<u4").astype(np.int64)


class Aligner:
    """Both tokenizers, with what is needed to align slices of documents."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), SpacedPieces(path_b)
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))
        # A token's id with what follows it in the text of groups.
        self.spelled = [f"{i}{mark}" for i in range(len(self.a.bytes)) for mark in ",|"]
        self.first_b = len(self.spelled)
        self.spelled += [f"{i}{mark}" for i in range(len(self.b.bytes)) for mark in (",", ";", "")]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both sides, or None where either does not spell the text with a space before it."""
        if not text:
            return None
        ids, spelled = (self.a.encode(text), self.b.encode(text)), (" " + text).encode("utf-8", "surrogatepass")
        if all(b"".join(map(side.bytes.__getitem__, i.tolist())) == spelled for side, i in zip((self.a, self.b), ids)):
            return ids
        return None

    def slices(self, batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
        for batch in batches:
            rows, docs, n = [], [], 0
            for k, text in enumerate(batch.column("text")):
                encoded = self.encode(text.as_py())
                rows.append(k)
                docs.append(encoded or (np.empty(0, np.int64), np.empty(0, np.int64)))
                n += len(docs[-1][0]) + len(docs[-1][1])
                if n >= SLICE_TOKENS:
                    yield Slice(self, batch.slice(rows[0], len(rows)), docs)
                    rows, docs, n = [], [], 0
            if rows:
                yield Slice(self, batch.slice(rows[0], len(rows)), docs)


class Slice:
    """Some documents side by side: their tokens are numbered through, and so are their bytes."""

    def __init__(self, aligner: Aligner, batch: pa.RecordBatch, docs: list[tuple[np.ndarray, np.ndarray]]):
        self.aligner, self.batch = aligner, batch
        none = np.empty(0, np.int64)
        self.ids_a, self.ids_b = (np.concatenate([none, *(d[side] for d in docs)]) for side in (0, 1))
        # Where each document's tokens begin, with the end of the last one.
        self.at_a, self.at_b = (np.cumsum([0, *(len(d[side]) for d in docs)]) for side in (0, 1))
        self.ends_a, self.ends_b = np.cumsum(aligner.lengths_a[self.ids_a]), np.cumsum(aligner.lengths_b[self.ids_b])

    def doc_of(self, tokens_a: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at_a, tokens_a, "right") - 1

    def group_texts(self, closing_a: np.ndarray, closing_b: np.ndarray) -> list[str]:
        """Each document's groups as text: the ids of A, then those of B, group by group."""
        n_groups, spelled, first_b = len(closing_a), self.aligner.spelled, self.aligner.first_b
        in_a = Csr.members(groups_of(len(self.ids_a), closing_a), n_groups).transposed.indptr
        in_b = Csr.members(groups_of(len(self.ids_b), closing_b), n_groups).transposed.indptr
        marks_a, marks_b = np.zeros(len(self.ids_a), np.int64), np.zeros(len(self.ids_b), np.int64)
        marks_a[closing_a] = marks_b[closing_b] = 1
        filled = np.flatnonzero(np.diff(self.at_b))
        marks_b[self.at_b[1:][filled] - 1] = 2
        codes = np.empty(len(self.ids_a) + len(self.ids_b), np.int64)
        codes[np.arange(len(self.ids_a)) + np.repeat(in_b[:-1], np.diff(in_a))] = self.ids_a * 2 + marks_a
        codes[np.arange(len(self.ids_b)) + np.repeat(in_a[1:], np.diff(in_b))] = first_b + self.ids_b * 3 + marks_b
        at = (self.at_a + self.at_b).tolist()
        return ["".join(map(spelled.__getitem__, codes[p:q].tolist())) for p, q in zip(at, at[1:])]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


# --- Spark jobs ----------------------------------------------------------------------------------------


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text")
    )


KINDS = {"overlap": overlap_links, "group": group_links}


def links(docs: DataFrame, path_a: str, path_b: str, kind: str = "overlap") -> DataFrame:
    """doc_id, token_a, token_b (their numbers in the document), id_a, id_b, n: the links of a kind.

    ``overlap``: tokens that share n bytes; ``end``: those among them that end together; ``group``: all tokens between two
    places where both sides end a token (n is 1).
    """
    if kind not in (*KINDS, "end"):
        raise ValueError(f"unknown kind of links: {kind}")
    columns = ("doc_id", "token_a", "token_b", "id_a", "id_b", "n")
    schema = pa.schema([(c, pa.int64()) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in aligner(path_a, path_b).slices(batches):
            doc_ids = part.batch.column("doc_id")
            for i, j, n in KINDS.get(kind, overlap_links)(part.ends_a, part.ends_b):
                if kind == "end":
                    same = part.ends_a[i] == part.ends_b[j]
                    i, j, n = i[same], j[same], n[same]
                doc = part.doc_of(i)
                found = [i - part.at_a[doc], j - part.at_b[doc], part.ids_a[i], part.ids_b[j], n]
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(doc)), *map(pa.array, found)], schema=schema)

    return _plain(docs).mapInArrow(run, ", ".join(f"{c} long" for c in columns))


BASE = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: its sizes, its groups' digest, and its distinct linked id pairs with how often each is linked.

    A pair is ``id_a << 20 | id_b``. Compute it once (store it) before using it more than once.
    """
    schema = pa.schema(
        [*((n, pa.int64()) for n in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()),
         ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in aligner(path_a, path_b).slices(batches):
            n_docs = part.batch.num_rows
            i, j = end_links(part.ends_a, part.ends_b)
            digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in part.group_texts(i, j)]
            doc = part.doc_of(i)
            # A slice has few documents, so document and pair share one number.
            keys, times = np.unique(doc << 2 * ID_BITS + 1 | part.ids_a[i] << ID_BITS | part.ids_b[j], return_counts=True)
            offsets = np.searchsorted(keys, np.arange(n_docs + 1) << 2 * ID_BITS + 1)
            n_links = np.bincount(doc, minlength=n_docs)
            values = [
                part.batch.column("row"), part.batch.column("doc_id"), np.diff(part.at_a), np.diff(part.at_b), n_links, n_links, digests,
            ]
            listed = [
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x))
                for x in (keys & (1 << 2 * ID_BITS + 1) - 1, times.astype(np.int32))
            ]
            arrays = [v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(values, schema)] + listed
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return _plain(docs).mapInArrow(run, BASE + ", pairs array<long>, times array<int>")


def count_pairs(aligned: DataFrame) -> DataFrame:
    """pair, n, is_best: how many links hold a pair corpus-wide, and whether no pair with its id of B has more."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        pairs, place = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        return pairs, np.bincount(place, np.concatenate([n for _, n in parts]), len(pairs)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting = [], 0
        for batch in batches:
            flat = batch.column("pairs").flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            parts.append(flat)
            waiting += len(flat[0])
            if waiting >= 4 * COUNTED_PAIRS:
                parts, waiting = [added(parts)], 0
                if len(parts[0][0]) >= COUNTED_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], schema=schema)
                    parts = []
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in added(parts)], schema=schema)

    summed = aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stash(summed.withColumn("id_b", F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1))), "pairs")
    # One row per id of B: as many as its vocabulary has.
    most = counts.groupBy("id_b").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "id_b").select("pair", "n", (F.col("n") == F.col("most")).alias("is_best"))


def _size_class(n):
    return F.floor(F.log2(n) * 16)


def with_counts(aligned: DataFrame, counts: DataFrame, frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """The documents of ``aligned`` with n_best (links of a best pair) and count_sum (counts summed over links)."""
    spark = aligned.sparkSession
    classes = counts.groupBy(_size_class("n").alias("size")).count().orderBy(F.desc("size")).collect()
    room, threshold = frequent, None
    for c in classes:
        room -= c["count"]
        if room < 0:
            break
        threshold = c["size"]
    is_frequent = _size_class("n") >= threshold if threshold is not None else F.lit(False)
    known = counts.filter(is_frequent).orderBy("pair").toArrow()
    shared = spark.sparkContext.broadcast([known.column(c).to_numpy() for c in ("pair", "n", "is_best")])
    base = [f.split() for f in BASE.split(", ")]
    schema = pa.schema(
        [*((n, pa.string() if t == "string" else pa.int64()) for n, t in base), ("n_best", pa.int64()), ("count_sum", pa.int64()),
         ("rare", pa.list_(pa.int64())), ("rare_times", pa.list_(pa.int32()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, is_best = shared.value
        for batch in batches:
            listed = batch.column("pairs")
            asked, times = listed.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy())
            place = np.searchsorted(pairs, asked)
            place[place == len(pairs)] = 0
            hit = pairs[place] == asked if len(pairs) else np.zeros(len(asked), bool)
            at, weight, whose = place[hit], times[hit], doc[hit]
            # Whole numbers, added without going through floating point.
            best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(best, whose, weight * is_best[at])
            np.add.at(total, whose, weight * n[at])
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[~hit], minlength=batch.num_rows))]), pa.int32())
            rare = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (asked[~hit], times[~hit].astype(np.int32))]
            kept = [batch.column(name) for name, _ in base]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(best), pa.array(total), *rare], schema=schema)

    looked = stash(aligned.mapInArrow(run, BASE + ", n_best long, count_sum long, rare array<long>, rare_times array<int>"), "looked")
    asked = looked.select("row", F.inline(F.arrays_zip(F.col("rare").alias("pair"), F.col("rare_times").alias("times"))))
    found = (
        asked.join(counts.filter(~is_frequent), "pair")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("is_best"), F.col("times").cast("long")).otherwise(F.lit(0).cast("long"))).alias("rare_best"),
            F.sum(F.col("times") * F.col("n")).alias("rare_sum"),
        )
    )
    none = F.lit(0).cast("long")
    return looked.join(found, "row", "left").select(
        *[n for n, _ in base if n != "row"],
        (F.col("n_best") + F.coalesce("rare_best", none)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("rare_sum", none)).alias("count_sum"),
    )


def align_documents(docs: DataFrame, path_a: str, path_b: str, frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every document."""
    aligned = stash(align(docs, path_a, path_b), "aligned")
    return with_counts(aligned, stash(count_pairs(aligned), "counts"), frequent)


# --- query ---------------------------------------------------------------------------------------------


def standard_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_token_alignment(spark, sf_dir):
    return align_documents(table(spark, sf_dir, "documents"), *standard_tokenizers()).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
