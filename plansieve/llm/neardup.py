"""Near-duplicate documents by an LSH forest of MinHash signatures.

A document is its set of word shingles; documents with equal sets are one node from the start, named by the set's hash and compared by
the text of one of them, however many rows share a set or a doc_id. Each of ``TREES`` trees
lists the nodes in the order of ``DEPTH`` MinHash values of its own. In a sorted order, neighbours with a long common prefix are
candidates: a node belongs to the region of its neighbour if they share ``MIN_DEPTH`` values, and in a region that has grown to
``DENSE`` nodes to a denser part of it only if they share more. The orders are range-partitioned, so even a region that holds a third of
all nodes is spread over many tasks; each node emits one link per tree (to the head of its part), each part one to its region. So
depth only balances the links: candidates are the nodes that share the first ``MIN_DEPTH`` values of a tree, joined in steps.

Candidate links are joined to clusters, and every cluster is compared on full sets, exactly: a signature estimate five standard
deviations below the threshold rules a pair out, all others are counted shingle by shingle unless the two are already connected. A
cluster of more than ``CELL`` nodes is compared in cells of bounded size: first its hub (a sample chosen by hash) with every
part, then whatever is not connected to the cluster's largest component with every part. Every pair of nodes in different
components meets in some cell, so cutting a cluster up loses no link.

Two documents at the threshold share no region in any tree with a probability of (1 - t ** MIN_DEPTH) ** TREES: 4e-7 for t = 0.85.

Defined results: a text without words has an empty set and is linked with nothing; a row without doc_id is linked with
nothing and has no component; repeated rows each get their own, equal, result, and rows of one doc_id with other words each that of
their set; an empty table gives an empty table; further columns are
ignored, or carried along by ``keep_one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansieve.llm.common import row_key, table, text_of
from plansieve.llm.components import components
from plansieve.llm.hashes import MIX, MIX2, lowered_words_of, mixed, run_hashes, word_hashes, word_slices
from plansieve.operators.narrow import stash

TREES = 20
DEPTH = 6
MIN_DEPTH = 4
DENSE = 1000
CELL = 128


@dataclass(frozen=True)
class Similarity:
    """Linked are sets with 100 * intersection >= percent * union, over shingles of ``width`` words."""

    width: int = 5
    percent: int = 80

    @property
    def least_estimate(self) -> float:
        t = self.percent / 100
        return t - 5 * (t * (1 - t) / (TREES * DEPTH)) ** 0.5


# --- sets and signatures -------------------------------------------------------------------------------


def shingle_sets(words: list[list[bytes]], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every document; fewer words than a shingle are one shingle, none are none."""
    flat, sizes = word_hashes(words)
    runs = run_hashes(flat, width, MIX)
    sets, at = [], 0
    for n in sizes.tolist():
        if n >= width:
            sets.append(np.unique(runs[at : at + n - width + 1]))
        else:
            # Marked by their length: no run of whole shingles hashes like that.
            sets.append(run_hashes(flat[at : at + n], n, MIX2) + np.uint64(n) if n else np.zeros(0, np.uint64))
        at += n
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """TREES * DEPTH MinHash values (32 bits) of every set, none of them empty."""
    flat = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), TREES * DEPTH), np.uint32)
    half = np.uint64(32)
    for k in range(TREES * DEPTH // 2):
        x = flat * (mixed(np.array([k + 1], np.uint64) * MIX) | np.uint64(1))
        x ^= x >> half
        x *= MIX2
        out[:, 2 * k] = np.minimum.reduceat(x >> half, first)
        out[:, 2 * k + 1] = np.minimum.reduceat((x ^ (x >> half)).astype(np.uint32), first)
    return out


def set_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """One hash of every (non-empty) set, whatever its order."""
    first = np.cumsum([0, *map(len, sets)])[:-1]
    sums = np.add.reduceat(mixed(np.concatenate(sets) * MIX), first)
    return mixed(sums + np.array([*map(len, sets)], np.uint64) * MIX2)


_MEMBERS_ARROW = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.int64()), ("signature", pa.binary())])


def describe(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_hash, signature (big-endian, so it sorts by value) of every row; null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in word_slices(batches, lowered_words_of):
            sets = shingle_sets(words, width)
            full = [k for k, s in enumerate(sets) if len(s)]
            hashes, signed = [None] * len(sets), [None] * len(sets)
            if full:
                some = [sets[k] for k in full]
                for k, h, row in zip(full, set_hashes(some).view(np.int64).tolist(), signatures(some).astype(">u4")):
                    hashes[k], signed[k] = h, row.tobytes()
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(map(len, sets), pa.int64()), pa.array(hashes, pa.int64()), pa.array(signed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=_MEMBERS_ARROW)

    return docs.select("doc_id", "text", "text_hash").mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_hash long, signature binary")


# --- forest --------------------------------------------------------------------------------------------

_LINKS_ARROW = pa.schema([("part", pa.int32()), ("key", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])


def forest_links(nodes: DataFrame) -> DataFrame:
    """a, b: candidate links between sorted neighbours; ``nodes`` has node and signature."""
    value, key_bytes = 4, 1 + 4 * MIN_DEPTH
    trees = nodes.select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    # The tree's number leads the key: prefixes of two trees share nothing.
    values = F.expr(f"substring(signature, tree * {value * DEPTH} + 1, {value * DEPTH})")
    ordered = (
        trees.select(F.concat(F.unhex(F.lpad(F.hex(F.col("tree")), 2, "0")), values).alias("key"), "node")
        .repartitionByRange("key", "node")
        .sortWithinPartitions("key", "node")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        before, region, head, size, last = b"", None, None, 0, None
        for batch in batches:
            edges: list[tuple] = []
            for key, node in zip(batch.column("key").to_pylist(), batch.column("node").to_pylist()):
                if key[:key_bytes] != before[:key_bytes]:
                    region, head, size = node, node, 0
                    if last is None:
                        edges.append((part, key, node, None))  # the first of the part: an earlier part may go on with its region
                else:
                    depth = min(DEPTH, MIN_DEPTH + size // DENSE)
                    if size >= DENSE and key[: 1 + value * depth] != before[: 1 + value * depth]:
                        edges.append((None, None, node, region))
                        head = node
                    elif head != node:
                        edges.append((None, None, node, head))
                size += 1
                before, last = key, node
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*edges), _LINKS_ARROW)], schema=_LINKS_ARROW) if edges else pa.RecordBatch.from_pylist([], schema=_LINKS_ARROW)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((part, before, None, last), _LINKS_ARROW)], schema=_LINKS_ARROW)

    found = stash(ordered.mapInArrow(run, "part int, key binary, a long, b long"), "forest")
    # Two rows per part: where one part's last region goes on in the next part, that part's first node follows its last.
    ends = found.where("part is not null").select(
        "part", F.substring("key", 1, key_bytes).alias("region"), F.coalesce("a", "b").alias("node"), F.col("a").isNull().alias("is_last")
    )
    order = Window.partitionBy("region").orderBy("part", "is_last")
    across = ends.withColumn("before", F.lag("node").over(order)).where("not is_last and before is not null")
    return found.where("part is null").select("a", "b").union(across.select(F.col("node").alias("a"), F.col("before").alias("b"))).distinct()


# --- exact comparison ----------------------------------------------------------------------------------


def connected(sets: list[np.ndarray], label: list[int], kind: Similarity) -> dict[int, int]:
    """Each label with the smallest one its sets are linked to, directly or in steps; equal labels are connected already."""
    parent = {x: x for x in label}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    n = len(sets)
    signed, sizes = signatures(sets), np.array([*map(len, sets)])
    pairs = []
    for i in range(n - 1):
        estimate = (signed[i + 1 :] == signed[i]).mean(axis=1)
        small, large = np.minimum(sizes[i], sizes[i + 1 :]), np.maximum(sizes[i], sizes[i + 1 :])
        likely = np.flatnonzero((estimate >= kind.least_estimate) & (100 * small >= kind.percent * large))
        pairs += [(-estimate[k], i, i + 1 + int(k)) for k in likely]
    for _, i, j in sorted(pairs):
        a, b = root(label[i]), root(label[j])
        if a == b:
            continue
        both = np.concatenate((sets[i], sets[j]))
        both.sort(kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        if 100 * common >= kind.percent * (len(both) - common):
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


_CONNECTED_ARROW = pa.schema([("cluster", pa.int64()), ("label", pa.int64()), ("head", pa.int64())])


def compare_cells(cells: DataFrame, texts: DataFrame, kind: Similarity) -> DataFrame:
    """cluster, label, head: what is connected within each cell.

    ``cells`` has cell, cluster, node and label, each cell with a bounded number of nodes; ``texts`` has node and text.
    """

    def run(group: pa.Table) -> pa.Table:
        # Text by text: the words of a whole cell of long texts would take many times the memory of its sets.
        sets = [shingle_sets([lowered_words_of(t.as_py())], kind.width)[0] for t in group.column("text")]
        label = group.column("label").to_pylist()
        heads = connected(sets, label, kind)
        cluster = [group.column("cluster")[0].as_py()] * len(heads)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (cluster, [*heads], [*heads.values()])], schema=_CONNECTED_ARROW)

    return cells.hint("shuffle_hash").join(texts, "node").groupBy("cell").applyInArrow(run, "cluster long, label long, head long")


def _part(node: Column, size: Column) -> Column:
    """A part of half a cell: parts of a cluster are numbered from 0."""
    return F.pmod(F.xxhash64(node), _n_parts(size)).cast("int")


def _n_parts(size: Column) -> Column:
    return F.ceil(size / (CELL // 2)).cast("int")


_SHINGLES_ARROW = pa.schema([("cluster", pa.int64()), ("node", pa.int64()), ("label", pa.int64()), ("n", pa.int64()), ("shingle", pa.int64())])


def shared_rare(left: DataFrame, texts: DataFrame, kind: Similarity) -> DataFrame:
    """cluster, node, label, list, m: each list are the ``m`` nodes of a cluster that share one of their rarest shingles.

    Linked sets have at least ``percent`` of either one in common. Of a set of n shingles, listed by their number of nodes in the cluster, the
    first n - ceil(percent * n / 100) + 1 therefore hold one that is among the first of the other set as well: every
    linked pair stands in a list. A text that clusters share word by word is in many nodes and so not among the rarest. Lists of one
    label tell nothing new, and lists of the same nodes count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in word_slices(batches, lowered_words_of):
            sets = shingle_sets(words, kind.width)
            sizes = np.array([*map(len, sets)])
            keys = [np.repeat(batch.column(c).to_numpy(), sizes) for c in ("cluster", "node", "label")]
            columns = [*keys, np.repeat(sizes, sizes), np.concatenate(sets).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_SHINGLES_ARROW)

    named = left.select("cluster", "node", "label").hint("shuffle_hash").join(texts, "node").select("cluster", "node", "label", "text")
    shingles = stash(named.mapInArrow(run, "cluster long, node long, label long, n long, shingle long"), "shingles")
    counts = shingles.groupBy("cluster", "shingle").agg(F.count("*").alias("n_nodes")).hint("merge")
    rank = F.row_number().over(Window.partitionBy("cluster", "node").orderBy("n_nodes", "shingle"))
    rarest = F.col("rank") <= F.col("n") - F.expr(f"({kind.percent} * n + 99) DIV 100") + 1
    rare = stash(
        shingles.join(counts, ["cluster", "shingle"]).withColumn("rank", rank).where(rarest & (F.col("n_nodes") > 1)).select("cluster", "node", "label", "shingle"),
        "rare",
    )
    # The same nodes, by their number and 128 bits of hash.
    members = [F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2")]
    lists = rare.groupBy("cluster", "shingle").agg(*members, (F.min("label") < F.max("label")).alias("crosses")).where("crosses")
    lists = lists.groupBy("cluster", "m", "h1", "h2").agg(F.min("shingle").alias("shingle")).select("cluster", "shingle", "m")
    return rare.join(lists.hint("merge"), ["cluster", "shingle"]).withColumnRenamed("shingle", "list")


def rest_cells(left: DataFrame, lists: DataFrame) -> DataFrame:
    """cell, cluster, node, label: the nodes of ``left`` in cells of bounded size, where every linked pair that is not connected meets.

    A cluster is dealt out by its lists (:func:`shared_rare`), long ones in pairs of parts, or, where that makes fewer rows, as a whole: what
    is not connected to its largest component meets every part.
    """
    n_parts = F.when(F.col("m") > CELL, _n_parts(F.col("m"))).otherwise(F.lit(1))
    others = F.greatest(n_parts - 1, F.lit(1))
    by_list = lists.groupBy("cluster").agg(F.sum(others).alias("by_list"))
    whole = left.groupBy("cluster").agg(F.first("size").alias("size"), F.first("n_rest").alias("n_rest"))
    by_whole = F.col("size") * _n_parts(F.col("n_rest")) + F.col("n_rest") * _n_parts(F.col("size"))
    way = whole.join(by_list, "cluster", "left").select("cluster", (F.coalesce("by_list", F.lit(0)) <= by_whole).alias("is_listed"))
    way = stash(way, "way")

    at = F.pmod(F.xxhash64("node"), n_parts).cast("int")
    meets = F.when(n_parts == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), n_parts - 1), lambda k: k != F.col("at")))
    listed = lists.join(way.where("is_listed").select("cluster"), "cluster", "left_semi").withColumn("at", at)
    listed = listed.select("cluster", "node", "label", "list", "at", F.explode(meets).alias("with")).select(
        F.struct("cluster", "list", F.least("at", "with").alias("one"), F.greatest("at", "with").alias("other")).alias("cell"), "cluster", "node", "label"
    )

    left = left.join(way.where("not is_listed").select("cluster"), "cluster", "left_semi")
    rest = left.where("label <> main").select(
        "node", "label", "cluster", _part(F.col("node"), F.col("n_rest")).alias("rest_part"), F.explode(F.sequence(F.lit(0), _n_parts(F.col("size")) - 1)).alias("part")
    )
    others = left.select(
        "node", "label", "cluster", F.explode(F.sequence(F.lit(0), _n_parts(F.col("n_rest")) - 1)).alias("rest_part"), "part"
    )
    cell = F.struct("cluster", F.lit(None).cast("long").alias("list"), F.col("rest_part").alias("one"), F.col("part").alias("other"))
    return listed.union(rest.union(others).distinct().select(cell.alias("cell"), "cluster", "node", "label"))


def find_components(docs: DataFrame, nodes: DataFrame, kind: Similarity) -> DataFrame:
    """node, component of every node that is a candidate of another one."""
    clusters = components(forest_links(nodes)).withColumnRenamed("component", "cluster")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    clusters = stash(clusters.join(sizes, "cluster").select("node", "cluster", "size", _part(F.col("node"), F.col("size")).alias("part")), "clusters")
    # The texts of all candidates are fetched once, by shuffle at every size; cells draw on these.
    candidates = clusters.select("node").join(nodes.select("node", "doc_id", "text_hash"), "node").hint("shuffle_hash")
    # Repeated rows are reduced in each task first, so that a node has one text.
    once = docs.dropDuplicates(["doc_id", "text_hash"])
    texts = stash(candidates.join(once, ["doc_id", "text_hash"]).select("node", "text"), "texts")
    is_large = F.col("size") > CELL
    # Hub nodes go to the cells of all parts: as many rows again as the cluster has.
    meets = F.when(~is_large, F.array(F.lit(0))).when(F.col("part") == 0, F.sequence(F.lit(1), _n_parts(F.col("size")) - 1)).otherwise(F.array("part"))
    cells = clusters.select("node", F.col("node").alias("label"), "cluster", F.explode(meets).alias("with"))
    compared = stash(compare_cells(cells.withColumn("cell", F.struct("cluster", "with")), texts, kind), "compared")
    large = clusters.where(is_large)
    if large.isEmpty():
        return compared.select(F.col("label").alias("node"), F.col("head").alias("component"))
    settled = compared.join(large.select("cluster").distinct(), "cluster", "left_anti").select(F.col("label").alias("node"), F.col("head").alias("component"))
    hub = components(compared.join(large.select("cluster").distinct(), "cluster", "left_semi").select(F.col("label").alias("a"), F.col("head").alias("b")))
    large = stash(large.join(hub, "node").select("node", "cluster", "size", "part", F.col("component").alias("label")), "large")
    counted = large.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    main = counted.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("whole"), F.max("n").alias("most"))
    # What is not connected to the cluster's largest component is compared with all that it may be linked to.
    left = large.join(main.select("cluster", "main", (F.col("whole") - F.col("most")).alias("n_rest")).where("n_rest > 0"), "cluster")
    left = stash(left.select("node", "label", "cluster", "size", "part", "main", "n_rest"), "left")
    cells = rest_cells(left, stash(shared_rare(left, texts, kind), "lists"))
    more = components(compare_cells(cells, texts, kind).select(F.col("label").alias("a"), F.col("head").alias("b")))
    later = more.select(F.col("node").alias("label"), "component")
    return settled.union(large.join(later, "label", "left").select("node", F.coalesce("component", "label")))


def _groups(docs: DataFrame, kind: Similarity) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept and group of every row.

    Groups are numbered by one of their nodes: two groups of different texts may have the same smallest doc_id. A row without doc_id or
    words has no group.
    """
    docs = docs.select(*row_key(F.col("doc_id").cast("long"), F.col("text")), text_of(F.col("text")).alias("text"))
    members = stash(describe(docs, kind.width), "members")
    nodes = stash(
        members.where("set_hash is not null and doc_id is not null")
        .groupBy("set_hash")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("signature").alias("signature"))
        .select(F.col("set_hash").alias("node"), "row.*", "signature"),
        "nodes",
    )
    found = stash(find_components(docs, nodes, kind).join(nodes.select("node", "doc_id"), "node"), "found")
    least = found.groupBy("component").agg(F.min("doc_id").alias("least"))
    of_node = found.join(least, "component").select("node", F.col("least").alias("component"), F.col("component").alias("group"))
    of_set = nodes.select(F.col("node").alias("set_hash"), "node", F.col("doc_id").alias("own")).join(of_node, "node", "left")
    of_set = of_set.select("set_hash", F.coalesce("component", "own").alias("component"), F.coalesce("group", "node").alias("group"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return members.join(of_set, "set_hash", "left").select(
        "doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        F.when(F.col("doc_id").isNotNull(), F.col("group")).alias("group"),
    )


def group_documents(docs: DataFrame, kind: Similarity) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    return _groups(docs, kind).drop("text_hash", "group")


def keep_one_of_each(docs: DataFrame, kind: Similarity) -> DataFrame:
    """One document of each group, all columns as they were: of those with its smallest doc_id, the text with the smallest hash.

    Rows of one doc_id whose texts are not linked are different documents and all stay. Of rows equal in doc_id and text one stays, that
    with the smallest hash of all its columns. Rows without doc_id are linked with nothing and all stay.
    """
    key = ["doc_id", "text_hash"]
    groups = stash(_groups(docs, kind).where("doc_id is not null"), "groups")
    first = groups.where("kept and group is not null").groupBy("group").agg(F.min(F.struct(*key)).alias("row")).select("row.*")
    stay = first.union(groups.where("group is null").select(*key).distinct())
    rows = docs.select(*row_key(F.col("doc_id").cast("long"), F.col("text")), F.struct("*").alias("row"))
    # By shuffle at every size: the documents that stay are a share of all, not a few.
    kept = rows.where("doc_id is not null").join(stay.hint("shuffle_hash"), key, "left_semi")
    without_id = rows.where("doc_id is null").select("row.*")
    again = stash(groups.groupBy(*key).count().where("count > 1").select(*key), "again")
    if again.isEmpty():
        return kept.select("row.*").union(without_id)
    # Repeated rows are reduced in each task before they are shuffled.
    once = kept.join(again, key, "left_semi").groupBy(*key).agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return kept.join(again, key, "left_anti").select("row.*").union(once.select("row.*")).union(without_id)


# --- query ---------------------------------------------------------------------------------------------

QUERY_KIND = Similarity(width=3, percent=85)


def op10_minhash_forest(spark, sf_dir):
    return group_documents(table(spark, sf_dir, "documents"), QUERY_KIND)
