"""Byte-level BPE from a rank file: encoding and decoding by a sentencepiece model that is serialised from the ranks.

A byte-level vocabulary writes each byte as one printable character. The tokens in that spelling are the pieces of a
sentencepiece BPE model, each scored by its negative rank, with identity normalisation; joining the best-scored pair again and
again is then what the rank file asks for. A text is cut by the vocabulary's own word pattern, each match is encoded by itself
(a match that is a token as a whole is that token), and decoding looks the pieces up and maps their characters back to bytes.

The pattern's character classes (letters, numbers, white space) differ between Unicode versions. Those of the tiktoken library
are asked for once, on the driver, and written out as ranges, so words are cut alike wherever a task runs.

Nothing is shuffled. The model (one entry per token) and the pattern travel to the tasks as broadcasts of about a megabyte.

Defined results: a null or empty text has no tokens and decodes to no bytes; a null doc_id stays null; repeated rows each get
their own equal row; very long texts and very long words are encoded whole; an empty table gives an empty table; further columns
are ignored.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansieve.llm.common import table, text_of

REMEMBERED_WORDS = 400_000
REMEMBERED_LENGTH = 64
CHARACTERS_AT_ONCE = 1_000_000
FEW_CHARACTERS = 0x10000


# --- the vocabulary ------------------------------------------------------------------------------------


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a base64 token and a number per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


@lru_cache(1)
def byte_letters() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else one from 256 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + hidden.index(b)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


# Field numbers and values of sentencepiece's model file (fixed values of its format).
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
TYPE_NORMAL, TYPE_UNKNOWN = 1, 2
MODEL_TYPE, MODEL_TYPE_BPE, VOCABULARY_SIZE = 3, 2, 4
NORMALIZER_NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES = 1, 3, 4, 5


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model of the tokens in order of rank, then one unknown piece, which no text can need."""
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary has no token for byte {missing[0]}")
    letters = byte_letters()

    def piece(text: str, score: float, kind: int) -> bytes:
        score_field = _varint(PIECE_SCORE << 3 | 5) + struct.pack("<f", score)
        return _bytes(PIECES, _bytes(PIECE_TEXT, text.encode()) + score_field + _number(PIECE_TYPE, kind))

    tokens = sorted(ranks, key=ranks.__getitem__)
    parts = [piece("".join(letters[b] for b in token), -ranks[token], TYPE_NORMAL) for token in tokens]
    parts.append(piece("<unk>", 0, TYPE_UNKNOWN))
    parts.append(_bytes(TRAINER, _number(MODEL_TYPE, MODEL_TYPE_BPE) + _number(VOCABULARY_SIZE, len(parts))))
    plain = [_number(k, 0) for k in (ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES)]
    parts.append(_bytes(NORMALIZER, _bytes(NORMALIZER_NAME, b"identity") + b"".join(plain)))
    return b"".join(parts)


def _ranges(chars: str) -> str:
    """The characters as ranges of a character class."""
    points = np.array([ord(c) for c in chars])
    starts = np.flatnonzero(np.diff(points, prepend=-2) != 1)
    ends = np.append(starts[1:], len(points)) - 1
    return "".join(rf"\U{points[a]:08x}-\U{points[b]:08x}" for a, b in zip(starts, ends))


@lru_cache(4)
def word_pattern(pattern: str, end: int = 0x110000) -> str:
    """The word pattern with its character classes written out as the tiktoken library understands them.

    With ``end`` only characters below it are listed, for texts that have no others: short classes are matched faster.
    """
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, end)]))
    single = {bytes([b]): b for b in range(256)}

    def members(cls: str) -> str:
        # What the pattern does not match is passed over, so what comes out is the class.
        found = tiktoken.Encoding("class", pat_str=cls, mergeable_ranks=single, special_tokens={})
        return _ranges(found.decode_bytes(found.encode_ordinary(every)).decode())

    written = {cls: members(cls) for cls in (r"\p{L}", r"\p{N}", r"\s") if cls in pattern or cls == r"\s"}
    written[r"\S"] = written[r"\s"]
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|\[|\]|[^\\\[\]]+", pattern, re.S):
        if part in written:
            if part == r"\S" and inside:
                raise ValueError(r"\S within a character class is not supported")
            part = written[part] if inside else f"[{'^' * (part == chr(92) + 'S')}{written[part]}]"
        elif part in ("[", "]"):
            inside = part == "["
        out.append(part)
    return "".join(out)


class Encoder:
    """Token ids of whole texts, as 32-bit numbers in bytes; remembers the short words it has met."""

    def __init__(self, model: bytes, numbers: np.ndarray, *patterns: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.numbers = numbers
        self.letters = dict(enumerate(byte_letters()))
        self.whole = {self.pieces.id_to_piece(k): n.tobytes() for k, n in enumerate(numbers)}
        self.few, self.every = (re.compile(p).findall for p in patterns)
        self.beyond = re.compile(f"[^\\x00-{chr(FEW_CHARACTERS - 1)}]").search
        self.known: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words by one call of the model; a word that is a token as a whole is that token."""
        words = list(words)
        spelled = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters) for w in words]
        cut = iter(self.pieces.encode([x for x in spelled if x not in self.whole], num_threads=1))
        return {w: self.whole.get(x) or self.numbers[next(cut)].tobytes() for w, x in zip(words, spelled)}

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [(self.every if self.beyond(t) else self.few)(t) for t in texts]
        if len(self.known) >= REMEMBERED_WORDS:
            self.known.clear()
        met = self.learn(set().union(*cut).difference(self.known))
        long = {w: ids for w, ids in met.items() if len(w) > REMEMBERED_LENGTH}
        self.known.update(met)
        out = [b"".join(map(self.known.__getitem__, words)) for words in cut]
        for word in long:
            del self.known[word]
        return out


class Vocabulary:
    """A rank file and its word pattern, ready to be used by tasks."""

    def __init__(self, spark, path: str, pattern: str):
        ranks = read_ranks(path)
        numbers = np.array(sorted(ranks.values()), np.int32)
        if len(set(ranks.values())) != len(ranks):
            raise ValueError("two tokens of the vocabulary have one rank")
        patterns = word_pattern(pattern, FEW_CHARACTERS), word_pattern(pattern)
        self.shared = spark.sparkContext.broadcast((serialise(ranks), numbers, *patterns))


# --- encoding and decoding -----------------------------------------------------------------------------


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """Where each portion of the texts begins, and its texts: some characters' worth at a time."""
    begin, texts, n = 0, [], 0
    for text in batch.column("text"):
        texts.append(text.as_py())
        n += len(texts[-1])
        if n >= CHARACTERS_AT_ONCE:
            yield begin, texts
            begin, texts, n = begin + len(texts), [], 0
    if texts:
        yield begin, texts


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, ids (array of int): the token ids of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    shared = vocabulary.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in batches:
            for begin, texts in _portions(batch):
                ids = encoder.encode(texts)
                ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, len(ids)), listed], schema=schema)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text"))
    return plain.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The rows of (doc_id, ids) with ``decoded``, the bytes that the ids stand for; null where ids is null.

    An id that the vocabulary does not have is an error.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
    shared = vocabulary.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model, numbers, *_ = shared.value
        pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        token = {int(n): bytes(byte_of[c] for c in pieces.id_to_piece(k)) for k, n in enumerate(numbers)}
        for batch in batches:
            listed = batch.column("ids")
            texts = [b"".join(map(token.__getitem__, ids.values.to_numpy().tolist())) if ids.is_valid else None for ids in listed]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), listed, pa.array(texts, pa.binary())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


# --- query ---------------------------------------------------------------------------------------------


def standard_vocabulary(spark) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_byte_bpe(spark, sf_dir):
    vocabulary = standard_vocabulary(spark)
    both = decode(encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
