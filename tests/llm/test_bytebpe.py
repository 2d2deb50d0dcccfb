"""Byte-level BPE against the tiktoken library."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_corpus import CLASHES, ODD, SF_DIR

from plansieve.llm import bytebpe


@pytest.fixture(scope="module")
def reference():
    ranks = bytebpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary(spark):
    return bytebpe.standard_vocabulary(spark)


def expected(reference, rows):
    out = []
    for doc_id, text in rows:
        ids = reference.encode_ordinary(text or "")
        digests = [hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), (text or "").encode())]
        out.append((doc_id, len(ids), *digests))
    return sorted(out, key=repr)


def test_query_against_the_library(spark, reference):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = bytebpe.op13_byte_bpe(spark, SF_DIR).collect()
    assert sorted(map(tuple, got), key=repr) == expected(reference, docs)


def test_odd_rows_and_round_trip(spark, vocabulary, reference):
    rng = random.Random(7)
    # Any code points, among them those that Unicode versions put into different classes.
    points = [*range(0x2FF), 0x558, 0x88F, 0x208F, 0xA7CE, 0x10940, 0x11DE0, 0x1246F, 0x1F600, 0x3000, 0x200B, 0x85, 0x1C]
    wild = ["".join(chr(rng.choice(points)) for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [*ODD, *[(1000 + k, t) for k, t in enumerate(wild)], (5000, "a" * 100_000), (5001, " " * 5000 + "x"), (5002, "don't 're  \n\n x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in [*CLASHES, "ids", "decoded"]})
    both = bytebpe.decode(bytebpe.encode(docs.repartition(3), vocabulary), vocabulary).collect()
    got = sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in both), key=repr)
    assert got == sorted(((d, reference.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows), key=repr)


def test_every_code_point_is_cut_as_the_library_cuts_it(reference):
    import re

    pattern = re.compile(bytebpe.word_pattern(public_tokenizers.PATTERN))
    chars = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x30000, 7), *range(0x10000, 0x14000)]]
    text = "".join(f"a{c}1{c}!{c} {c}" for c in chars)
    assert [i for w in pattern.findall(text) for i in reference.encode_ordinary(w)] == reference.encode_ordinary(text)


def test_a_token_no_merges_lead_to_is_taken_whole(spark, tmp_path):
    import base64

    tokens = [*(bytes([b]) for b in range(256)), b"bc", b"abc", b"xyz"]
    path = tmp_path / "small.tiktoken"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {3 * k + 5}\n" for k, t in enumerate(tokens)))
    own = tiktoken.Encoding("own", pat_str=r"\p{L}+|\S", mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["xyz", "xyza abc", "bcabcxyz\n1", "abc"])], "doc_id long, text string")
    got = bytebpe.encode(docs, bytebpe.Vocabulary(spark, str(path), r"\p{L}+|\S")).collect()
    assert {r.doc_id: r.ids for r in got} == {r.doc_id: own.encode_ordinary(r.text) for r in docs.collect()}


def test_empty_table_and_bad_vocabularies(spark, vocabulary, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bytebpe.decode(bytebpe.encode(empty, vocabulary), vocabulary).collect() == []
    with pytest.raises(ValueError, match="no token for byte"):
        bytebpe.serialise({b"a": 0})
