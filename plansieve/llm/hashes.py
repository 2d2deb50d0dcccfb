"""Words of texts as bytes, and hashes of words and of runs of words as numpy arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_WORDS = 200_000

# Odd constants with bits all over; any would do.
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str) -> list[bytes]:
    """The words between ASCII white space (space, tab to carriage return), as they stand."""
    return text.encode("utf-8", "surrogatepass").split()


def lowered_words_of(text: str) -> list[bytes]:
    """The words with A-Z lowered; on bytes, lowering touches nothing but A-Z."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_slices(
    batches: Iterator[pa.RecordBatch], words_of: Callable[[str], list[bytes]] = words_of, size: int = SLICE_WORDS
) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of the input (column text, no nulls) with their words, about ``size`` words at a time."""
    for batch in batches:
        words, n, begin = [], 0, 0
        for k, text in enumerate(batch.column("text")):
            words.append(words_of(text.as_py()))
            n += len(words[-1])
            if n >= size:
                yield batch.slice(begin, k + 1 - begin), words
                words, n, begin = [], 0, k + 1
        if words:
            yield batch.slice(begin), words


def word_hashes(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, one document after the other, and the documents' sizes."""
    import xxhash

    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((h for w in words for h in map(xxhash.xxh3_64_intdigest, w)), np.uint64, int(sizes.sum()))
    return flat, sizes


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * MIX2
    return x ^ (x >> np.uint64(32))


def run_hashes(h: np.ndarray, n: int, factor: np.uint64) -> np.ndarray:
    """A hash of the n values from each position on (as many results as there are whole runs)."""
    m = max(0, len(h) - n + 1)
    out = h[:m].copy()
    for k in range(1, n):
        out *= factor
        out += h[k : k + m]
    return mixed(out)
