"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. What is stored is the ledger: one row per document with the
measurements and one ``failed`` bit per rule. Policies are versioned masks over those bits: applying one, comparing
two or asking what a rule alone decides is bitwise work on the ledger and never reads the texts again.

All of it happens inside the row, in built-in functions: nothing is shuffled to measure a document. Repeated
three-word windows are found from their 64-bit hashes: documents whose windows are all different (most are) end there; in the
others the windows are sorted within the row.

Defined results: a null text has no words and every measurement 0; it fails the rules on too few words and no others;
repeated rows each get their own equal row; an empty table gives an empty ledger; further columns are carried along in
``apply_policy`` and ignored elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansieve.llm.common import SPACES, split_words, table, text_of

SYMBOLS = "[#*$%&|<>]"
REPEAT_WINDOW = 3


# --- measurements --------------------------------------------------------------------------------------


def _repeated_words(words: Column, windows: Column) -> Column:
    """Words inside windows found twice or more, given each window's hash in order."""
    n = F.size(windows)
    # Sorted by hash, equal windows are neighbours; their starts go on in order.
    by_hash = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.transform(
        F.filter(
            F.arrays_zip(
                by_hash.alias("w"),
                F.concat(F.array(F.lit(None).cast("long")), F.transform(F.slice(by_hash, 1, n - 1), lambda w: w["h"])).alias("before"),
                F.concat(F.transform(F.slice(by_hash, 2, n), lambda w: w["h"]), F.array(F.lit(None).cast("long"))).alias("after"),
            ),
            lambda w: (F.coalesce(w["before"] == w["w"]["h"], F.lit(False)) | F.coalesce(w["after"] == w["w"]["h"], F.lit(False))),
        ),
        lambda w: w["w"]["i"],
    )
    return F.aggregate(
        F.array_sort(repeated),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda acc, i: F.struct(
            (acc["n"] + i + REPEAT_WINDOW - F.greatest(acc["upto"], i)).alias("n"), (i + REPEAT_WINDOW).alias("upto")
        ),
        lambda acc: acc["n"],
    )


def measured(docs: DataFrame) -> DataFrame:
    """row (the whole input row) and its measurements."""
    text = text_of(F.col("row.text"))
    zero = F.lit(0).cast("long")
    first = docs.select(F.struct("*").alias("row")).select("row", split_words(text, SPACES).alias("words"))
    windows = F.when(
        F.size("words") >= REPEAT_WINDOW,
        F.transform(
            F.sequence(F.lit(1), F.size("words") - REPEAT_WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, REPEAT_WINDOW))
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    second = first.select(
        "row", "words", windows.alias("windows"), F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("lines")
    )
    measurements = F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(text).cast("long").alias("n_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) == F.size("windows"), zero)
        .otherwise(_repeated_words(F.col("words"), F.col("windows")))
        .alias("n_repeat_words"),
    )
    # Unfolding a list of one keeps later filters from being pushed below it, where each mention of a measurement would be
    # measured again.
    return second.select("row", F.inline(F.array(measurements)))


# --- rules and ledger ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A named test over the measurements; ``bit`` is its place in the ledger and never reused."""

    bit: int
    name: str
    fails: Column = field(repr=False)


def standard_rules() -> list[Rule]:
    n, col = F.col("n_words"), F.col
    return [
        Rule(0, "few_words", n < 50),
        Rule(1, "repeated_words", 100 * col("n_repeat_words") > 50 * n),
        Rule(2, "many_symbols", 100 * col("n_symbols") > 50 * n),
        Rule(3, "repeated_lines", 100 * col("n_dup_lines") > 50 * col("n_lines")),
        Rule(4, "short_words", col("word_chars") < 2 * n),
        Rule(5, "long_words", col("word_chars") > 20 * n),
        Rule(6, "many_words", n > 100_000),
        Rule(7, "some_symbols", 100 * col("n_symbols") > 10 * n),
        Rule(8, "some_repeated_words", 100 * col("n_repeat_words") > 30 * n),
    ]


@dataclass(frozen=True)
class Policy:
    """A version of what counts: a document is kept if it fails none of these rules."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: list[Rule]) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[name] for name in self.rules)


BASE_RULES = ("few_words", "repeated_words")
POLICIES = {
    "base": Policy("base", BASE_RULES),
    "2": Policy("2", (*BASE_RULES, "many_symbols", "repeated_lines", "short_words", "long_words")),
    # One symbol to ten words is the published limit for web text.
    "3": Policy("3", (*BASE_RULES, "some_symbols", "repeated_lines", "short_words", "long_words")),
    "3-strict": Policy("3-strict", (*BASE_RULES, "some_symbols", "repeated_lines", "short_words", "long_words", "many_words", "some_repeated_words")),
}
CURRENT = POLICIES["3"]


def ledger(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """row, the measurements, and ``failed``: the bits of the rules that the document fails."""
    rules = rules or standard_rules()
    if len({r.bit for r in rules}) < len(rules):
        raise ValueError("two rules share a bit")
    failed = F.lit(0).cast("long")
    for rule in rules:
        failed = failed.bitwiseOR(F.when(rule.fails, F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measured(docs).withColumn("failed", failed)


def fails_policy(failed: Column, policy: Policy, rules: list[Rule] | None = None) -> Column:
    return failed.bitwiseAND(F.lit(policy.mask(rules or standard_rules())).cast("long")) != 0


def apply_policy(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The documents that the policy keeps, all columns as they were."""
    return ledger(docs).where(~fails_policy(F.col("failed"), policy)).select("row.*")


def ablations(entries: DataFrame, policies: list[Policy], rules: list[Rule] | None = None) -> DataFrame:
    """version, rule, n_failed, n_only: documents that fail a rule, and those that only this rule of the policy rejects.

    ``entries`` is a ledger. Documents are first counted by their bits (a small table whatever the corpus), and the
    policies are asked of those counts.
    """
    rules = rules or standard_rules()
    bits = {r.name: r.bit for r in rules}
    counts = entries.groupBy("failed").agg(F.count("*").alias("n_docs"))
    asked = F.explode(
        F.array(
            *[
                F.struct(F.lit(p.version).alias("version"), F.lit(name).alias("rule"), F.lit(1 << bits[name]).cast("long").alias("bit"), F.lit(p.mask(rules)).cast("long").alias("mask"))
                for p in policies
                for name in p.rules
            ]
        )
    )
    masked = F.col("failed").bitwiseAND(F.col("ask.mask"))
    return (
        counts.select("failed", "n_docs", asked.alias("ask"))
        .groupBy("ask.version", "ask.rule")
        .agg(
            F.coalesce(F.sum(F.when(F.col("failed").bitwiseAND(F.col("ask.bit")) != 0, F.col("n_docs"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(masked == F.col("ask.bit"), F.col("n_docs"))), F.lit(0)).alias("n_only"),
        )
    )


def report(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """doc_id, the measurements, base_failed, kept and the bits."""
    return ledger(docs).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        fails_policy(F.col("failed"), POLICIES["base"]).alias("base_failed"),
        (~fails_policy(F.col("failed"), policy)).alias("kept"),
        "failed",
    )


# --- query ---------------------------------------------------------------------------------------------


def op6_quality_rules(spark, sf_dir):
    return report(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
),
win AS (SELECT r, i, w[i + 1 : i + 3] AS win FROM (SELECT r, w, unnest(range(len(w) - 2)) AS i FROM d WHERE len(w) > 2)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM again) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (r)
),
bits AS (
  SELECT *,
    CASE WHEN n_words < 50 THEN 1 ELSE 0 END | CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    | CASE WHEN 100 * n_symbols > 50 * n_words THEN 4 ELSE 0 END | CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    | CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END | CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
    | CASE WHEN n_words > 100000 THEN 64 ELSE 0 END | CASE WHEN 100 * n_symbols > 10 * n_words THEN 128 ELSE 0 END
    | CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 256 ELSE 0 END AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed,
  failed & 187 = 0 AS kept, CAST(failed AS BIGINT) AS failed
FROM bits
"""
