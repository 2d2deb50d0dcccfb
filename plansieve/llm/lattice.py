"""Language-model scores from a subword lattice.

An existing piece vocabulary supplies the pieces; their weights come from the training documents. The probability of a word is the
sum over all its segmentations into pieces, found by a forward recursion in log space; a word begins with the space
mark, so no piece crosses words and a document's probability is the product over its words and its end. That makes the lattice
a matter of distinct words: each is scored once, wherever it stands.

Counts are sums over all training words. The most frequent words' scores (at most ``frequent_words`` of them) are
broadcast; every other word of a document is joined with its score by shuffle, so nothing is left out and no frequent word
is a hot key of the join.

Defined results: a null or empty text is its end alone; a document counts as held out if crc32 of its doc_id as text
(null: the empty text) has remainder 2 by 7; repeated rows each get their own equal row and train as often as they stand;
very long words are scored whole; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansieve.llm.common import row_key, table, text_of
from plansieve.llm.hashes import lowered_words_of
from plansieve.operators.narrow import stash

SPACE_MARK = "▁"
END_PIECE = 2
FREQUENT_WORDS = 200_000  # about 250 bytes each in a worker
COUNTED_WORDS = 200_000  # a task hands on its counts when it has so many words


# --- counting ------------------------------------------------------------------------------------------


def count_words(docs: DataFrame) -> DataFrame:
    """word, c: every word of all documents with its count in training documents (0 if it stands in others only)."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, seen = Counter(), set()

        def hand_on() -> pa.RecordBatch:
            others = [w for w in seen if w not in trained]
            words, counts = [*trained, *others], [*trained.values(), *[0] * len(others)]
            trained.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], schema=schema)

        for batch in batches:
            for held_out, text in zip(batch.column("held_out").to_pylist(), batch.column("text")):
                (seen if held_out else trained).update(lowered_words_of(text.as_py()))
                if len(trained) + len(seen) >= COUNTED_WORDS:
                    yield hand_on()
        if trained or seen:
            yield hand_on()

    return docs.select("held_out", "text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Pieces:
    """A piece vocabulary with the log probabilities of its pieces."""

    def __init__(self, model_file: str, counts: dict[int, int]):
        import sentencepiece

        vocabulary = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [i for i in range(vocabulary.get_piece_size()) if not vocabulary.is_unknown(i) and (i == END_PIECE or not vocabulary.is_control(i))]
        whole = math.log(sum(counts.get(i, 0) for i in ids) + len(ids))
        log_of = {i: math.log(counts.get(i, 0) + 1) - whole for i in ids}
        self.end = log_of[END_PIECE]
        self.bytes = {int(vocabulary.id_to_piece(i)[1:-1], 16): x for i, x in log_of.items() if vocabulary.is_byte(i)}
        # Beginnings of pieces map to None, so a search stops where no piece goes on.
        self.known: dict[str, float | None] = {}
        for i, x in log_of.items():
            if i != END_PIECE and not vocabulary.is_byte(i):
                piece = vocabulary.id_to_piece(i)
                for n in range(1, len(piece)):
                    self.known.setdefault(piece[:n], None)
                self.known[piece] = x

    def log_probability(self, word: str) -> float:
        """Natural log of the summed probability of all segmentations of the word, space mark included."""
        text, known = SPACE_MARK + word, self.known
        n = len(text)
        arriving: list[list[float]] = [[] for _ in range(n + 1)]
        here = 0.0
        for i in range(n):
            if i:
                terms = arriving[i]
                top = max(terms)
                here = top if len(terms) == 1 else top + math.log(sum([math.exp(t - top) for t in terms]))
                arriving[i] = []
            single = known.get(text[i])
            if single is None:
                arriving[i + 1].append(here + sum(self.bytes[b] for b in text[i].encode("utf-8", "surrogatepass")))
            j = i + 1
            while j <= n and (part := text[i:j]) in known:
                if (x := known[part]) is not None:
                    arriving[j].append(here + x)
                j += 1
        top = max(arriving[n])
        return top + math.log(sum(math.exp(t - top) for t in arriving[n]))


def count_pieces(words: DataFrame, model_file: str) -> dict[int, int]:
    """How often each piece stands in the words as the vocabulary's own encoder cuts them; at most one entry per piece."""
    schema = pa.schema([("piece", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        vocabulary = sentencepiece.SentencePieceProcessor(model_file=model_file)
        total = np.zeros(vocabulary.get_piece_size(), np.int64)
        for batch in batches:
            cut = vocabulary.encode([w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()], num_threads=1)
            sizes = np.fromiter(map(len, cut), np.int64, len(cut))
            ids = np.fromiter((i for word in cut for i in word), np.int64, int(sizes.sum()))
            np.add.at(total, ids, np.repeat(batch.column("c").to_numpy(), sizes))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], schema=schema)

    counted = words.where("c > 0").mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return {r["piece"]: r["n"] for r in counted.collect()}


# --- scoring -------------------------------------------------------------------------------------------


def score_words(words: DataFrame, model_file: str, piece_counts: dict[int, int], denominator: int) -> DataFrame:
    """word, c, base, score: log10 of its smoothed share of the tokens, and of its marginal probability."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model_file, piece_counts)
        for batch in batches:
            base = np.log10((batch.column("c").to_numpy() + 1) / denominator)
            score = [pieces.log_probability(w.decode("utf-8", "surrogatepass")) for w in batch.column("word").to_pylist()]
            columns = [batch.column("word"), batch.column("c"), pa.array(base), pa.array(np.array(score, np.float64) / math.log(10))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return words.mapInArrow(run, "word binary, c long, base double, score double")


def most_frequent(words: DataFrame, at_most: int) -> DataFrame:
    """The words above a count, chosen so that there are no more than ``at_most``.

    The count is found from a histogram over sixteenths of a doubling, some hundred rows, so no task sorts the words.
    """
    step = F.floor(F.log2("c") * 16)
    rows = words.where("c > 0").groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()
    least, taken = math.inf, 0
    for r in sorted(rows, reverse=True):
        taken += r["n"]
        if taken > at_most:
            break
        least = r["step"]
    return words.where("c > 0").where(step >= least) if rows and least < math.inf else words.where("false")


_EMITTED = "doc_id long, text_hash long, word binary, tf long, n_tokens long, n_known long, base double, score double"
_EMITTED_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("word", pa.binary()), ("tf", pa.int64()), ("n_tokens", pa.int64()),
     ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]
)


def _sum_frequent(docs: DataFrame, frequent: dict[bytes, tuple[bool, float, float]]) -> DataFrame:
    """A row per document with the sums over its frequent words, and a row for each of its other words."""
    known = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, none = known.value.get, (None, None, None, None)
        for batch in batches:
            columns: list[list] = [[] for _ in _EMITTED_ARROW]

            def emit() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _EMITTED_ARROW)], schema=_EMITTED_ARROW)

            ids, hashes = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
            for doc_id, text_hash, text in zip(ids, hashes, batch.column("text")):
                words = lowered_words_of(text.as_py())
                n_known, base_sum, score_sum, rare = 0, 0.0, 0.0, []
                for word, tf in Counter(words).items():
                    if entry := get(word):
                        there, base, score = entry
                        n_known += tf * there
                        base_sum += tf * base
                        score_sum += tf * score
                    else:
                        rare.append((doc_id, text_hash, word, tf, *none))
                # No word begins with a space: the document's own row meets no word and lies with no other.
                rare.append((doc_id, text_hash, b" %d" % text_hash, 0, len(words), n_known, base_sum, score_sum))
                for column, values in zip(columns, zip(*rare)):
                    column.extend(values)
                if len(columns[0]) >= 50_000:
                    yield emit()
                    columns = [[] for _ in _EMITTED_ARROW]
            yield emit()

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, _EMITTED)


def score_documents(docs: DataFrame, model_file: str, frequent_words: int = FREQUENT_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    held_out = F.crc32(text_of(F.col("doc_id").cast("string"))) % 7 == 2
    texts = docs.select(*row_key(F.col("doc_id").cast("long"), F.col("text")), held_out.alias("held_out"), text_of(F.col("text")).alias("text"))
    words = stash(count_words(texts), "lattice-words")
    n_train = texts.where(~F.col("held_out")).count()
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, v = totals["n"] + n_train, totals["v"] + (n_train > 0)
    denominator = n + v + 1
    piece_counts = count_pieces(words, model_file) | {END_PIECE: n_train}
    scored = stash(score_words(words, model_file, piece_counts, denominator), "lattice-scores")
    top = most_frequent(scored, frequent_words).toArrow()
    frequent = {
        bytes(word): (c > 0, base, score)
        for word, c, base, score in zip(*(top.column(k).to_pylist() for k in ("word", "c", "base", "score")))
    }
    end_base, end_score = math.log10((n_train + 1) / denominator), Pieces(model_file, piece_counts).end / math.log(10)
    emitted = _sum_frequent(texts, frequent)
    looked_up = scored.select("word", (F.col("c") > 0).cast("long").alias("w_known"), F.col("base").alias("w_base"), F.col("score").alias("w_score"))
    parts = emitted.join(looked_up, "word", "left").select(
        "doc_id",
        "text_hash",
        "n_tokens",
        F.coalesce("n_known", F.col("tf") * F.col("w_known")).alias("n_known"),
        F.coalesce("base", F.col("tf") * F.col("w_base")).alias("base"),
        F.coalesce("score", F.col("tf") * F.col("w_score")).alias("score"),
    )
    # Repeated rows have added up: their number is the number of document rows.
    per_key = parts.groupBy("doc_id", "text_hash").agg(
        F.count("n_tokens").alias("copies"), F.max("n_tokens").alias("n_words"), *[F.sum(c).alias(c) for c in ("n_known", "base", "score")]
    )
    return per_key.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id",
        held_out.alias("held_out"),
        (F.col("n_words") + 1).alias("n_tokens"),
        ((F.col("n_known") / F.col("copies")).cast("long") + int(n_train > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies") + end_base).alias("base_score"),
        (F.col("score") / F.col("copies") + end_score).alias("score"),
    )


# --- query ---------------------------------------------------------------------------------------------


def standard_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_lattice_score(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"), standard_pieces())
