"""Token alignment against plain loops over the two libraries' own tokens."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_corpus import CLASHES, ODD, SF_DIR
from tokenizers import Tokenizer

from plansieve.llm import alignment
from plansieve.llm.bytebpe import byte_letters


@pytest.fixture(scope="module")
def libraries():
    path_a, path_b = alignment.standard_tokenizers()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=path_b)


def tokens(libraries, text):
    """(id, begin, end) of both sides, or nothing."""
    a, b = libraries
    byte_of = {c: k for k, c in enumerate(byte_letters())}
    want = (" " + (text or "")).encode()
    found_a = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + (text or ""), add_special_tokens=False).ids]
    found_b = []
    for i in b.encode(text or ""):
        piece = b.id_to_piece(i)
        found_b.append((i, bytes([int(piece[1:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    if not text or any(b"".join(x for _, x in side) != want for side in (found_a, found_b)):
        return [], []
    sides = []
    for side in (found_a, found_b):
        ends = np.cumsum([len(x) for _, x in side]).tolist()
        sides.append([(i, e - len(x), e) for (i, x), e in zip(side, ends)])
    return tuple(sides)


def expected(libraries, rows):
    per_doc, counts = [], Counter()
    for doc_id, text in rows:
        a, b = tokens(libraries, text)
        ends_b = {e: i for i, _, e in b}
        linked = [(i, ends_b[e]) for i, _, e in a if e in ends_b]
        counts.update(linked)
        groups, cuts = [], [e for _, _, e in a if e in ends_b]
        at = [0, 0]
        for cut in cuts:
            inside = [[], []]
            for k, side in enumerate((a, b)):
                while at[k] < len(side) and side[at[k]][2] <= cut:
                    inside[k].append(str(side[at[k]][0]))
                    at[k] += 1
            groups.append("|".join(map(",".join, inside)))
        per_doc.append((doc_id, a, b, linked, ";".join(groups), len(groups)))
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return sorted(
        (
            (doc_id, len(a), len(b), n_groups, len(linked), sum(counts[p] == most[p[1]] for p in linked), sum(counts[p] for p in linked),
             hashlib.sha256(text.encode()).hexdigest() if a else "")
            for doc_id, a, b, linked, text, n_groups in per_doc
        ),
        key=repr,
    )


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
STRANGE = [
    (100, "a▁b"), (101, "  two  spaces   and three "), (102, " "), (103, "<|endoftext|> <s> </s> <unk> <0x41>"), (104, "日本語 と 한국어\tтекст 🙂🙂 ½"),
    (105, "\r\n\r\n x\r\n"), (106, "x" * 5000), (107, "é" * 700 + " ́a"), (108, "\x00\x01 ​﻿"), (109, "don't  can't 12345 3.14"),
]


def test_query_against_plain_loops(spark, libraries):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = alignment.op11_token_alignment(spark, SF_DIR)
    assert got.columns == list(COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(libraries, docs)


@pytest.mark.parametrize("frequent", [0, 50])
def test_odd_rows_with_any_broadcast_limit(spark, libraries, frequent):
    rows = [*ODD, *STRANGE, *STRANGE]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in [*CLASHES, "pairs", "times"]})
    got = alignment.align_documents(docs.repartition(3), *alignment.standard_tokenizers(), frequent=frequent)
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=repr) == expected(libraries, rows)


@pytest.mark.parametrize("kind", ["overlap", "end", "group"])
def test_links_of_every_kind(spark, libraries, kind):
    rows = [r for r in [*ODD, *STRANGE] if r[1] and len(r[1]) < 2000]
    want = []
    for doc_id, text in rows:
        a, b = tokens(libraries, text)
        cuts = {e for _, _, e in a} & {e for _, _, e in b}
        for p, (i, s, e) in enumerate(a):
            for q, (j, t, f) in enumerate(b):
                n = min(e, f) - max(s, t)
                if kind == "group":
                    n = int(sum(c < e for c in cuts) == sum(c < f for c in cuts))
                if n > 0 and (kind != "end" or e == f):
                    want.append((doc_id, p, q, i, j, n))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = alignment.links(docs, *alignment.standard_tokenizers(), kind).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_products_and_windows_of_any_size():
    rng = np.random.default_rng(5)
    for _ in range(50):
        dense = [rng.integers(0, 3, shape) for shape in ((7, 9), (9, 5))]
        sparse = []
        for m in dense:
            r, c = np.nonzero(m)
            sparse.append(alignment.Csr(np.searchsorted(r, np.arange(len(m) + 1)), c, m[r, c], m.shape[1]))
        for most in (1, 4, 1000):
            out = np.zeros((7, 5), int)
            for i, j, n in alignment.product(*sparse, most=most):
                out[i, j] += n
            assert (out == dense[0] @ dense[1]).all()
        cuts = [np.append(np.sort(rng.choice(199, 60, replace=False)) + 1, 200) for _ in range(2)]
        whole = {(i, j): n for block in alignment.overlap_links(*cuts) for i, j, n in zip(*map(np.ndarray.tolist, block))}
        for size in (1, 7, 50):
            assert whole == {(i, j): n for block in alignment.overlap_links(*cuts, size) for i, j, n in zip(*map(np.ndarray.tolist, block))}
            i, j = alignment.end_links(*cuts, size)
            assert (cuts[0][i] == cuts[1][j]).all() and len(i) == len(np.intersect1d(*cuts))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_documents(empty, *alignment.standard_tokenizers()).collect() == []
