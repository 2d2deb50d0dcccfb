"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, scanned for in every document.

A window is ``width`` consecutive words of an item; an item of fewer words is one window. Each document's windows
are hashed inside its row, looked up in the broadcast set by that hash, and a hit is verified word by word before it
counts. Words inside verified windows are hit words; they can be cut out (:func:`remove_spans`) or their documents
dropped (:func:`remove_documents`).

The set is broadcast only below ``max_broadcast_windows``; a larger benchmark is joined by shuffle, hash by hash, with
the same rows as result. Then every window is shuffled with its own words, about ``width`` times the text for each window size, and one
narrow row per document that takes no part in the join; if the set is broadcast, only hits and that row are shuffled.

Defined results: a null or wordless text has no words and no hit; a null or wordless item has no window; repeated
document rows each get their own, equal, result row; repeated items count by distinct item_id; a null item_id counts as
an item listed as ``''``; with an empty benchmark nothing is hit; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansieve.llm.common import NOT_ALNUM, NOT_ALNUM_ANY_CASE, lower_ascii, row_key, split_words, table, text_of

WIDTH = 10
MAX_BROADCAST_WINDOWS = 2_000_000  # about 250 bytes each


def words_of(text: Column) -> Column:
    return split_words(lower_ascii(text), NOT_ALNUM)


def _window_starts(words: Column, width: int) -> Column:
    """0 to n - width, none if there are fewer words."""
    return F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(
        F.array().cast("array<int>")
    )


def _window(words: Column, start: Column, width: int | Column) -> Column:
    return F.slice(words, start + 1, width)


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def benchmark_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """window_hash, window (its words), item_ids: every distinct window with the items that hold it."""
    words = items.select(text_of(F.col("item_id").cast("string")).alias("item_id"), words_of(F.col("text")).alias("words"))
    words = words.where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(width))
    windows = words.select(
        "item_id",
        F.explode(
            F.transform(F.sequence(F.lit(0), F.size("words") - size), lambda i: F.slice("words", i + 1, size))
        ).alias("window"),
    )
    return windows.groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")).select(
        F.xxhash64(word_hashes(F.col("window"))).alias("window_hash"), "window", "item_ids"
    )


def find_hits(docs: DataFrame, items: DataFrame, width: int = WIDTH, max_broadcast_windows: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, text_hash, n_words, hits (struct of start and size), item_ids; one row per document row."""
    windows = benchmark_windows(items, width)
    # At most ``width`` different sizes: full windows and the short items'.
    sizes = sorted(r[0] for r in windows.select(F.size("window")).distinct().collect())
    key = row_key(F.col("doc_id"), F.col("text"))
    docs = docs.select(*key, words_of(F.col("text")).alias("words"))
    if not sizes:
        nothing = F.array().cast("array<struct<start:int,size:int>>").alias("hits")
        return docs.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), nothing, F.array().cast("array<string>").alias("item_ids"))
    # Each word is hashed once; a window's hash is that of its words' hashes.
    docs = docs.withColumn("hashes", word_hashes(F.col("words")))
    words, hashes = F.col("words"), F.col("hashes")

    def probes_of(size: int) -> Column:
        return F.transform(
            _window_starts(hashes, size),
            lambda i: F.struct(
                i.alias("start"), F.lit(size).alias("size"), F.xxhash64(_window(hashes, i, size)).alias("window_hash")
            ),
        )

    header = F.struct(F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit(None).cast("long").alias("window_hash"))
    known = windows.withColumnRenamed("window_hash", "known_hash")
    same_hash, own = F.col("window_hash") == F.col("known_hash"), _window(words, F.col("start"), F.col("size"))
    if windows.limit(max_broadcast_windows + 1).count() <= max_broadcast_windows:
        # Each document's first probe is its header: it meets no window and keeps the document, hit or not.
        probes = F.concat(F.array(header), *[probes_of(size) for size in sizes])
        # The list is a column of its own, so that unfolding it is compiled and does not copy the words for every window. It is never
        # empty; the outer form keeps a test of that, which would cut the text up anew for every window, from being pushed down.
        scanned = docs.withColumn("probes", probes).select("doc_id", "text_hash", "words", F.explode_outer("probes").alias("probe"))
        scanned = scanned.select("doc_id", "text_hash", "words", "probe.*", F.size("words").cast("long").alias("n_words"))
        met = scanned.join(F.broadcast(known), same_hash & (own == F.col("window")), "left").where((F.col("size") == 0) | F.col("window").isNotNull())
    else:
        # A window is shuffled with its own words, not with its document's; headers are not joined.
        scanned = docs.select("doc_id", "text_hash", "words", F.explode(F.concat(*[probes_of(size) for size in sizes])).alias("probe"))
        scanned = scanned.select("doc_id", "text_hash", "words", "probe.*").select("doc_id", "text_hash", "start", "size", "window_hash", own.alias("own"))
        # Dealt out before the join, so that cutting the window out is not moved behind the shuffle.
        met = scanned.repartition("window_hash").join(known.hint("shuffle_hash"), same_hash & (F.col("own") == F.col("window")))
        met = met.select("doc_id", "text_hash", "start", "size", F.lit(None).cast("long").alias("n_words"), "item_ids")
        met = met.union(
            docs.select("doc_id", "text_hash", F.lit(0), F.lit(0), F.size("words").cast("long"), F.lit(None).cast("array<string>"))
        )
    rows = met.select(
        "doc_id",
        "text_hash",
        F.when(F.col("size") == 0, F.col("n_words")).alias("n_words"),
        F.when(F.col("size") > 0, F.struct("start", "size")).alias("hit"),
        "item_ids",
    )
    per_key = rows.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.count("n_words").alias("copies"),
        F.array_sort(F.collect_set("hit")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
    )
    return per_key.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "copy")


def covered(hits: Column) -> Column:
    """How many words the (sorted) windows cover together."""
    return F.aggregate(
        hits,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda acc, h: F.struct(
            (acc["n"] + F.greatest(F.lit(0), h["start"] + h["size"] - F.greatest(acc["upto"], h["start"]))).alias("n"),
            F.greatest(acc["upto"], h["start"] + h["size"]).alias("upto"),
        ),
        lambda acc: acc["n"],
    )


def merged(hits: Column) -> Column:
    """The (sorted) windows as disjoint spans of start and upto."""
    return F.aggregate(
        hits,
        F.array().cast("array<struct<start:int,upto:int>>"),
        lambda acc, h: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["upto"] >= h["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["start"].alias("start"),
                        F.greatest(F.element_at(acc, -1)["upto"], h["start"] + h["size"]).alias("upto"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(h["start"].alias("start"), (h["start"] + h["size"]).alias("upto"))))),
    )


def report(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_hits(docs, items, width)
    return found.select(
        "doc_id",
        "n_words",
        covered(F.col("hits")).alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def _hit_rows(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    found = find_hits(docs, items, width).where(F.size("hits") > 0)
    return found.select(F.struct("doc_id", "text_hash").alias("hit_key"), "hits").dropDuplicates(["hit_key"])


def remove_documents(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without any hit word, all columns as they were."""
    rows = docs.select(F.struct("*").alias("row"), F.struct(*row_key(F.col("doc_id"), F.col("text"))).alias("key"))
    hit = _hit_rows(docs, items, width)
    return rows.join(hit, F.col("key").eqNullSafe(F.col("hit_key")), "left_anti").select("row.*")


def remove_spans(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """All documents; in those with hits, the hit words are cut and the other words joined by single spaces."""
    rows = docs.select(F.struct("*").alias("row"), F.struct(*row_key(F.col("doc_id"), F.col("text"))).alias("key"))
    hit = _hit_rows(docs, items, width)
    joined = rows.join(hit, F.col("key").eqNullSafe(F.col("hit_key")), "left").select("row", "hits")
    words = split_words(F.col("row.text"), NOT_ALNUM_ANY_CASE)
    spans = merged(F.col("hits"))
    # What is kept lies between each span's end and the next one's start.
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["upto"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.size(words)))
    gaps = F.arrays_zip(ends.alias("a"), starts.alias("b"))
    kept = F.flatten(F.transform(gaps, lambda g: F.slice(words, g["a"] + 1, g["b"] - g["a"])))
    text = F.when(F.col("hits").isNull(), F.col("row.text")).otherwise(F.array_join(kept, " "))
    return joined.select(F.col("row").withField("text", text).alias("row")).select("row.*")


# --- query ---------------------------------------------------------------------------------------------


def op2_decontamination(spark, sf_dir):
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = """list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"""

OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS size, w[i + 1 : i + least(len(w), {WIDTH})] AS win
  FROM (SELECT item_id, w, unnest(range(len(w) - least(len(w), {WIDTH}) + 1)) AS i FROM b WHERE len(w) > 0)
),
dw AS (
  SELECT r, i, size, w[i + 1 : i + size] AS win
  FROM (SELECT r, w, size, unnest(range(len(w) - size + 1)) AS i FROM d, (SELECT DISTINCT size FROM bw) s WHERE len(w) >= size)
),
hits AS (SELECT dw.r, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.win = bw.win),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
