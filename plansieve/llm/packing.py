"""Packing tokenised documents into sequences of one size by minimum bin slack.

Documents are encoded once and cut into full pieces (a sequence each) and one remainder shorter than a sequence.
The remainders are packed by their lengths alone: however many documents there are, there are fewer than
``capacity`` different lengths, so the plan is made from a histogram of that size. Again and again the largest length left
opens a sequence; a bitset subset-sum over the lengths left finds the sum closest to what remains, the multiset behind it
is traced back, and the pattern is used as often as its counts allow. Each piece then finds its sequence from its
rank among the pieces of its length: a look-up, not a search. Ranks are counted bucket by bucket; the only rows shuffled are
narrow ones, one per piece.

Defined results: a null or empty text is its end token alone; repeated rows are packed each for itself; an empty table gives an
empty table; very long texts are encoded whole and give many full pieces; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansieve.llm.common import numbered, table, text_of
from plansieve.operators.narrow import stash

CAPACITY = 2048
END_ID = 1
REMAINDER_BUCKETS = 256
FULL_BUCKETS = 65_536


# --- encoding ------------------------------------------------------------------------------------------

# Letters, digits and other characters of which every Unicode version says the same; texts with any other
# character are encoded by the tokenizer itself.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏЀ-ҁҊ-ԯぁ-ゖァ-ヺ一-鿿가-힣"
OTHERS = "×÷«»¡¿§°€£–—‘’“”„•…"
FAMILIAR = re.compile(f"[\\x00-\\x1b\\x20-\\x7e{LETTERS}{OTHERS}]*")
# The published word pattern of this tokenizer family, for familiar characters.
PRETOKENS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\\s0-9{LETTERS}]+|\\s+(?!\\S)|\\s+"
)
CACHED_PRETOKENS = 400_000


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself if it is one, else one from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder(dict):
    """Token ids of whole texts as little-endian 32-bit bytes; remembers what words it has encoded."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters, special = _byte_letters(), {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.words = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_PRETOKENS:
            self.clear()
        ids = self[word] = np.array(self.words.encode_ordinary(word), "<u4").tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if FAMILIAR.fullmatch(text) and not (self.special and self.special.search(text)):
            return b"".join(map(self.__getitem__, PRETOKENS.findall(text)))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def encode_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece of a document: where it starts, its length and checksum, and with ``keep_ids`` its ids."""
    fields = [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * keep_ids)
    end = np.array([END_ID], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            columns: list[list] = [[] for _ in schema]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = enc.encode(text.as_py()) + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    row = [doc_id, start, len(piece) // 4, zlib.crc32(piece), n]
                    for column, value in zip(columns, row + [np.frombuffer(piece, "<u4").astype(np.int64)] * keep_ids):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text")).mapInArrow(
        encode, PIECES + ", ids array<long>" * keep_ids
    )


# --- the plan ------------------------------------------------------------------------------------------


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (at most ``counts`` of each) whose sum is the largest that fits into ``room``.

    Bit s of ``reach`` tells whether the sum s can be made; counts are split into powers of two, so a length is
    shifted in a few times at most. The steps are traced back from the highest bit.
    """
    inside, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & inside
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


@dataclass(frozen=True)
class Pattern:
    """Sequences first_sequence ... first_sequence + times - 1 all hold these lengths, so many of each."""

    lengths: dict[int, int]
    times: int
    first_sequence: int


def minimum_bin_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    counts, patterns, sequence = {k: n for k, n in histogram.items() if n}, [], 0
    while counts:
        largest = max(counts)
        rest = counts | {largest: counts[largest] - 1}
        chosen = fullest({k: n for k, n in rest.items() if n}, capacity - largest)
        chosen[largest] = chosen.get(largest, 0) + 1
        times = min(counts[k] // n for k, n in chosen.items())
        patterns.append(Pattern(chosen, times, sequence))
        sequence += times
        for k, n in chosen.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return patterns


def rank_ranges(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, pieces a sequence, first sequence, offset in it), sorted by length and rank."""
    used: dict[int, int] = {}
    rows = []
    for p in patterns:
        offset = 0
        for length, n in sorted(p.lengths.items(), reverse=True):
            rows.append((length, used.get(length, 0), n, p.first_sequence, offset))
            used[length] = used.get(length, 0) + n * p.times
            offset += n * length
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids), sequence_id, offset: every piece with its place."""
    pieces = stash(encode_pieces(docs, tokenizer, capacity, keep_ids), "packing")
    spread = F.when(F.col("length") == capacity, F.lit(FULL_BUCKETS)).otherwise(F.lit(REMAINDER_BUCKETS))
    ranked = numbered(
        pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), spread)),
        "length",
        ["doc_id", "start", "ids_crc32"],
        "bucket",
    )
    # Fewer than ``capacity`` rows, whatever the corpus.
    histogram = {r["length"]: r["n"] for r in pieces.where(F.col("length") < capacity).groupBy("length").agg(F.count("*").alias("n")).collect()}
    patterns = minimum_bin_slack(histogram, capacity)
    ranges = rank_ranges(patterns)
    n_packed = sum(p.times for p in patterns)
    rank_bits = 40  # lengths and ranks share one sorted number
    firsts = (ranges[:, 0] << rank_bits) + ranges[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "slot"))
            sequence, offset = rank + n_packed, np.zeros(len(rank), np.int64)
            short = length < capacity
            at = np.searchsorted(firsts, (length[short] << rank_bits) + rank[short], "right") - 1
            _, first, each, first_sequence, first_offset = ranges[at].T
            nth = rank[short] - first
            sequence[short] = first_sequence + nth // each
            offset[short] = first_offset + nth % each * length[short]
            kept = batch.drop_columns(["slot"])
            yield kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    kinds = PIECES + ", ids array<long>" * keep_ids
    return ranked.select(*columns, "slot").mapInArrow(place, kinds + ", sequence_id long, offset long")


# --- query ---------------------------------------------------------------------------------------------


def standard_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), standard_tokenizer())
