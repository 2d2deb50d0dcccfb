"""The prefix trie against plain Python and SQL, and list ranking against a walk."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_corpus import CLASHES, SF_DIR
from verify import compare, connect

from plansieve.llm import listrank, prefixtrie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def expected(rows):
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            turns[conv_id].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(role, text) for _, _, role, text in sorted(listed)] for c, listed in turns.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[: d - 1]].add(path[:d])
        ends[path].append(c)
    out = []
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1]) if node else 0
    for node, convs in members.items():
        digest = hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        parent = members[node[:-1]][0] if node else None
        out.append((convs[0], len(node), parent, len(convs), len(children[node]), leaves[node], saved[node], digest))
    return sorted(out, key=repr)


def trie(df):
    return prefixtrie.prefix_trie(*prefixtrie.shared_beginnings(prefixtrie.ordered_turns(df)))


def test_query_against_sql_and_plain_python(spark):
    problem, n, _ = compare(spark, connect(SF_DIR), "op12_prefix_trie", SF_DIR)
    assert problem is None and n > 20
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, prefixtrie.op12_prefix_trie(spark, SF_DIR).collect()), key=repr) == expected(rows)


def test_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "CHUNK_TURNS", 7)
    monkeypatch.setattr(prefixtrie, "HOT_SHARE", 20)
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "é", "", None, "long " * 9])) for c in range(260) for t in range(rng.randrange(9))]
    rows += [(0, None, "user", "first"), (0, None, "user", "first"), (300, 5, None, None), (301, 1, "user", "hi"), (None, 1, "user", "lost")]
    rows += [(700, t, "user", f"turn {t % 3}") for t in range(60)] + [(c, 0, "user", "same") for c in range(20_000, 20_040)]
    rows += [(20_041, -1, "user", "x" * 100_000), (20_041, 2**40, "user", "y"), (9_000_000_000, 1, "", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = trie(df.withColumns({c: F.lit("x") for c in [*CLASHES, "pos", "mark", "id", "depth"]}).repartition(5))
    assert got.columns == list(COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_empty_table(spark):
    assert trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


@pytest.mark.parametrize("order", ["along the key", "at random"])
def test_list_ranking(spark, order):
    n, rng = 600, random.Random(1)
    ids = list(range(n))
    rng.shuffle(ids)
    places = range(n) if order == "along the key" else rng.sample(range(n), n)
    rows, want, a, b = [], [], 0, 0
    for i, (x, place) in enumerate(zip(ids, places)):
        rows.append((x, ids[i + 1] if i + 1 < n else listrank.END, i % 3, -i, place))
        want.append((x, a, b))
        a, b = a + i % 3, b - i
    df = spark.createDataFrame(rows, "id long, next long, a long, b long, k long").repartition(4)
    got = listrank.sums_before(df, ["k"], ["a", "b"], last_rows=200, per_task=lambda n: 150)
    assert sorted(map(tuple, got.collect())) == sorted(want)
