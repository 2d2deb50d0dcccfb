"""Rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair draws a number u in (0, 1) from a hash of both, and the key goes to the shard with the
largest ``-weight / ln(u)``. A shard that is added draws numbers of its own and changes none of the others, so the
only rows that move are those it wins: its share of the weight, and none between old shards. Nothing is looked up
and nothing is shuffled to find a shard.

Defined results: a null key is the key ``''``; rows of one key share a shard; a null text has size 1 (0 bytes plus 1)
and checksum 0; an empty table gives an empty table; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansieve.llm.common import numbered, table, text_of
from plansieve.operators.narrow import stash

# Rows of a shard are numbered bucket by bucket; a bucket of a shard is what one task sorts.
BUCKET_DIGITS = 3
DRAW_DIGITS = 12


def _hex_number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that the key and the shard decide."""
    digest = F.md5(F.concat(text_of(key.cast("string")), F.lit(f"@{shard}")))
    return (_hex_number(F.substring(digest, 1, DRAW_DIGITS)) + 0.5) / float(16**DRAW_DIGITS)


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of a key; a shard of weight 0 gets nothing, ties go to the smaller shard number."""
    scored = [
        F.struct((F.lit(-float(weight)) / F.log(draw(key, shard))).alias("score"), F.lit(-shard).alias("neg"))
        for shard, weight in weights.items()
        if weight > 0
    ]
    if not scored:
        raise ValueError("no shard has a weight above 0")
    return -F.array_max(F.array(*scored))["neg"]


def shard_documents(docs: DataFrame, weights: Mapping[int, float], grown_weights: Mapping[int, float]) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; no text is shuffled or stored."""
    key, text = F.col("doc_id"), F.col("text")
    checksum = F.crc32(text_of(text))
    digest = F.md5(F.concat_ws("#", text_of(key.cast("string")), checksum.cast("string")))
    rows = docs.select(
        key,
        (F.octet_length(text_of(text)).cast("long") + 1).alias("size"),
        checksum.alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, grown_weights).alias("grown_shard"),
        _hex_number(F.substring(digest, 1, BUCKET_DIGITS)).alias("bucket"),
    )
    return numbered(stash(rows, "sharding"), "shard", ["doc_id", "text_crc32", "size"], "bucket")


# --- query ---------------------------------------------------------------------------------------------

N_SHARDS = 8


def op1_sharding(spark, sf_dir):
    return shard_documents(
        table(spark, sf_dir, "documents"),
        {s: 1.0 for s in range(N_SHARDS)},
        {s: 1.0 for s in range(N_SHARDS + 1)},
    ).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


# The CRC-32 table by its rule (polynomial 0xEDB88320), as a list of 256 numbers.
_CRC_TABLE = """
crc_bits(n, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM crc_bits WHERE k < 8
),
crc AS (SELECT list(c ORDER BY n) AS tab FROM crc_bits WHERE k = 8)
"""

OP1_SQL = f"""
WITH RECURSIVE {_CRC_TABLE.strip()},
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, coalesce(text, '') AS text FROM documents),
sized AS (
  SELECT doc_id, key, octet_length(encode(text)) + 1 AS size,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM d, crc
),
drawn AS (
  SELECT s.*, h.range AS shard,
    -1.0 / ln((CAST('0x' || substr(md5(key || '@' || h.range), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0) AS score
  FROM sized s, range(9) h
),
placed AS (
  SELECT doc_id, key, size, text_crc32,
    arg_max(shard, score) FILTER (shard < 8) AS shard, arg_max(shard, score) AS grown_shard, count(*) // 9 AS copies
  FROM drawn GROUP BY doc_id, key, size, text_crc32
),
again AS (SELECT doc_id, key, size, text_crc32, shard, grown_shard, unnest(range(copies)) FROM placed)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(key || '#' || text_crc32), 1, 3), doc_id, text_crc32, size) - 1 AS slot,
  CAST(grown_shard AS INTEGER) AS grown_shard
FROM again
"""
