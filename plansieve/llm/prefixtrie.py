"""The trie of conversations' beginnings, with subtree sums by an Euler tour.

A node is a distinct sequence of first turns. Its identity is 128 bits: the exclusive or, turn by turn, of hashes of a turn's
position and its MD5, so a node's parent is known from the row of its last turn and no text is shuffled. The tour
goes down the left side of every node and up its right side: each node has an enter and an exit arc, and each arc knows the
next one. The list of arcs is ranked on the cluster (``listrank``), and what stands between a node's two arcs, as a
difference of two prefix sums, is the sum over its subtree: its leaves, and the code points saved by storing it once.

Hot keys: a conversation of any length is numbered in ranges of its turns; nodes are aggregated before they are shuffled; the few
nodes with more than a thousandth of all nodes as children are broadcast, other children meet their parent by shuffle; the members
that end at one node are joined to text in blocks of 4,096 possible ids and hashed block after block.

Defined results: turns of one number are taken in the order of the MD5 of role and text, repeated rows stay turns of their own;
a null turn stands first; a null role or text is empty; rows without a conv_id belong to no conversation and are left out; texts
of any length are hashed whole; an empty table gives an empty table (no root); further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansieve.llm.common import table, text_of
from plansieve.llm.listrank import END, sums_before
from plansieve.llm.sharding import _CRC_TABLE
from plansieve.operators.narrow import stash

CHUNK_TURNS = 100_000
HOT_SHARE = 1000
BLOCK_BITS = 12
NODE = ["depth", "s1", "s2"]


# --- running values along a key ------------------------------------------------------------------------


def running(rows: DataFrame, key: str, order: list[Column], xors: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``nth``, from 1 in the order within the key, and the columns ``xors`` replaced by their running exclusive or.

    Rows are dealt in ranges of key and order, so a key of any size is spread; what a task has to carry in from the ranges
    before it is one row for each range.
    """
    schema = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = ", ".join(f"{n} {t}" for n, t in schema.items()) + ", nth long, range long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, carried, n_carried = TaskContext.get().partitionId(), None, [np.int64(0)] * len(xors), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at = batch.column(key).to_numpy()
            begins = np.concatenate([[last is None or at[0] != last], at[1:] != at[:-1]])
            start = np.maximum.accumulate(np.where(begins, np.arange(n), -1))
            nth = np.arange(n) - start + np.where(start < 0, n_carried, 1)
            columns = {name: batch.column(name) for name in schema}
            for k, name in enumerate(xors):
                all_before = np.bitwise_xor.accumulate(batch.column(name).to_numpy())
                base = np.where(start < 0, carried[k], np.where(start > 0, all_before[np.maximum(start - 1, 0)], 0))
                columns[name] = pa.array(all_before ^ base)
                carried[k] = (all_before ^ base)[-1]
            last, n_carried = at[-1], int(nth[-1])
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(nth), pa.array(np.full(n, task))], [*columns, "nth", "range"])

    dealt = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    local = stash(dealt.mapInArrow(run, out), "running")
    last = local.groupBy(key, "range").agg(F.max(F.struct("nth", *xors)).alias("last"))
    before = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(
        key, "range", F.sum("last.nth").over(before).alias("_nth"), *[F.bit_xor(f"last.{x}").over(before).alias(f"_{x}") for x in xors]
    ).filter(F.col("_nth").isNotNull())
    kept = [c for c in rows.columns if c not in xors]
    return local.join(F.broadcast(carried), [key, "range"], "left").select(
        *kept,
        (F.col("nth") + F.coalesce("_nth", F.lit(0).cast("long"))).alias("nth"),
        *[F.col(x).bitwiseXOR(F.coalesce(f"_{x}", F.lit(0).cast("long"))).alias(x) for x in xors],
    )


# --- conversations -------------------------------------------------------------------------------------


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), mark (MD5 of role and text), chars (code points of the text)."""
    role, text = text_of(F.col("role")), text_of(F.col("text"))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("mark"),
        F.char_length(text).cast("long").alias("chars"),
    )
    numbered = running(turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("mark")])
    return stash(numbered.select("conv_id", F.col("nth").alias("pos"), "mark", "chars"), "turns")


def shared_beginnings(turns: DataFrame, family: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, conv_ids) of conversations c that begin with the first turns of conversation c - c % family.

    h = crc32(decimal c) % most of its turns are taken (all if it has fewer), and c's own turns after its first h follow.
    """
    heads = turns.filter((F.col("pos") < most) & (F.col("conv_id") % family == 0)).select(F.col("conv_id").alias("base"), "pos", "mark", "chars")
    # A conversation stands here once per chunk of its turns, so no key of a join has more than a chunk of them.
    chunk = F.expr(f"pos DIV {CHUNK_TURNS}").alias("chunk")
    chunks = turns.select("conv_id", chunk).distinct().withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    chunks = chunks.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    n_heads = heads.groupBy("base").agg(F.max("pos").alias("n_base"))
    chunks = stash(chunks.join(n_heads, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0).cast("long")))), "chunks")
    begun = chunks.filter("chunk = 0").join(heads, "base").filter("pos <= h").select("conv_id", "pos", "mark", "chars")
    own = turns.withColumn("chunk", chunk).join(chunks.select("conv_id", "chunk", "h", "taken"), ["conv_id", "chunk"]).filter("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "mark", "chars")
    return begun.unionByName(own), chunks.filter("chunk = 0").select("conv_id")


# --- the trie ------------------------------------------------------------------------------------------


def _digests(ends: DataFrame) -> DataFrame:
    """Per node, ``ends_sha256``: the hash of its members' ids in ascending order, from blocks of them one after the other."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = ends.withColumn("block", F.shiftright("conv_id", BLOCK_BITS)).groupBy(*NODE, "block").agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in node), pa.array([digest.hexdigest()])], [*NODE, "ends_sha256"])

        for batch in batches:
            for *at, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
                if at == node:
                    digest.update(b",")
                else:
                    if node:
                        yield row()
                    node, digest = at, hashlib.sha256()
                digest.update(ids.encode())
        if node:
            yield row()

    dealt = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids")
    return dealt.mapInArrow(run, "depth long, s1 long, s2 long, ends_sha256 string")


def _with_parents(nodes: DataFrame, n_nodes: int) -> DataFrame:
    """Nodes with n_children, and with their parent's id and conv_id."""
    n_children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("s1"), F.col("p2").alias("s2")).count()
    nodes = stash(nodes.join(n_children.withColumnRenamed("count", "n_children"), NODE, "left").fillna(0, ["n_children"]), "nodes")
    parents = nodes.filter("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("id").alias("parent"),
        F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") * HOT_SHARE > n_nodes).alias("is_hot"),
    )
    key = ["depth", "p1", "p2"]
    # All children together are fewer than the nodes, so fewer than HOT_SHARE parents are hot.
    hot = nodes.join(F.broadcast(parents.filter("is_hot").drop("is_hot")), key, "left")
    rest = hot.filter(F.col("parent").isNull()).drop("parent", "parent_conv_id").join(parents.filter("NOT is_hot").drop("is_hot"), key, "left")
    return hot.filter(F.col("parent").isNotNull()).unionByName(rest)


def _arcs(nodes: DataFrame) -> DataFrame:
    """The Euler tour as a list: arc 2 id enters a node, arc 2 id + 1 leaves it; children come in order of their conv_id."""
    ranked = running(nodes.filter("depth > 0").select("parent", "conv_id", "id"), "parent", [F.col("conv_id")])
    ranked = stash(ranked.select("parent", "nth", "id"), "ranked")
    sibling = ranked.select("parent", (F.col("nth") - 1).alias("nth"), F.col("id").alias("sibling"))
    following = ranked.join(sibling, ["parent", "nth"], "left").select("id", "sibling")
    first = ranked.filter("nth = 1").select(F.col("parent").alias("id"), F.col("id").alias("child"))
    entering = F.struct(
        (F.col("id") * 2).alias("id"),
        F.coalesce(F.col("child") * 2, F.col("id") * 2 + 1).alias("next"),
        (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    nothing = F.lit(0).cast("long")
    leaving = F.struct(
        (F.col("id") * 2 + 1).alias("id"),
        F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1, F.lit(END)).cast("long").alias("next"),
        nothing.alias("leaves"),
        nothing.alias("saved"),
    )
    return nodes.join(first, "id", "left").join(following, "id", "left").select("conv_id", "depth", F.inline(F.array(entering, leaving)))


def prefix_trie(turns: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, pos from 1 without gaps, mark, chars).

    ``conv_ids`` are all conversations, those without turns included: they end at the root.
    """
    marked = turns.select(
        "conv_id", "pos", "chars", F.xxhash64("pos", "mark").alias("s1"), F.xxhash64("mark", F.lit("second"), "pos").alias("s2")
    )
    own = marked.select("*", F.col("s1").alias("x1"), F.col("s2").alias("x2"))
    steps = running(own, "conv_id", [F.col("pos")], ("s1", "s2")).select(
        "conv_id", F.col("pos").alias("depth"), "chars", "s1", "s2", F.col("s1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("s2").bitwiseXOR(F.col("x2")).alias("p2")
    )
    steps = stash(steps, "steps")
    members = [F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")]
    none = F.lit(0).cast("long")
    root = conv_ids.agg(*members).filter("n_convs > 0").select(*[none.alias(c) for c in NODE], "conv_id", "n_convs", *[none.alias(c) for c in ("chars", "p1", "p2")])
    nodes = steps.groupBy(*NODE).agg(*members, *[F.max(c).alias(c) for c in ("chars", "p1", "p2")])
    nodes = stash(nodes.unionByName(root).withColumn("id", F.monotonically_increasing_id()), "nodes")
    nodes = stash(_with_parents(nodes, nodes.count()), "family")

    last = steps.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("last"))
    ends = conv_ids.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(f"last.{c}", none).alias(c) for c in NODE])

    sums = sums_before(_arcs(nodes), ["conv_id", "depth"], ["leaves", "saved"])
    # A node's subtree lies between its two arcs.
    side = F.when(F.col("id") % 2 == 1, 1).otherwise(-1)
    below = sums.groupBy(F.shiftright("id", 1).alias("id")).agg(
        F.sum(side * F.col("before_leaves")).alias("n_leaves"), F.sum(side * F.col("before_saved")).alias("saved_tokens")
    )
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    found = nodes.join(below, "id").join(_digests(ends), NODE, "left")
    return found.withColumn("ends_sha256", F.coalesce("ends_sha256", empty)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


# --- query ---------------------------------------------------------------------------------------------


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie(*shared_beginnings(ordered_turns(table(spark, sf_dir, "conversations"))))


OP12_SQL = f"""
WITH RECURSIVE {_CRC_TABLE.strip()},
t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(CAST(conv_id AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc),
rebuilt AS (
  SELECT c.conv_id, t.pos, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= h
  UNION ALL SELECT c.conv_id, t.pos + 10, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > h),
steps AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars, string_agg(md5(length(role) || ':' || role || text), '') OVER w AS path
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
linked AS (SELECT *, substr(path, 1, length(path) - 32) AS parent, max(depth) OVER (PARTITION BY conv_id) AS n_turns FROM steps),
nodes AS (
  SELECT depth, path, parent, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
    sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (depth = n_turns), '')) AS ends_sha256
  FROM linked GROUP BY ALL),
kids AS (SELECT depth - 1 AS depth, parent AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
tree AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (depth, path)),
sums AS (
  SELECT s.depth, s.path, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * tree.chars) AS BIGINT) AS saved_tokens
  FROM tree JOIN steps s ON s.conv_id = tree.conv_id AND s.depth <= tree.depth GROUP BY ALL)
SELECT tree.conv_id, tree.depth, p.conv_id AS parent_conv_id, tree.n_convs, tree.n_children, n_leaves, saved_tokens, tree.ends_sha256
FROM tree JOIN sums USING (depth, path) LEFT JOIN tree p ON tree.depth > 0 AND p.depth = tree.depth - 1 AND p.path = tree.parent
"""
