"""The corpus operators as queries over the test tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plansieve.llm import alignment, bytebpe, decontaminate, lattice, licenses, mainhtml, neardup, packing, prefixtrie, quality, sharding, substrings, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": sharding.op1_sharding,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_lattice_score": lattice.op3_lattice_score,
    "op4_warc": warc.op4_warc,
    "op5_packing": packing.op5_packing,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_substring_dedup": substrings.op7_substring_dedup,
    "op8_html_extraction": mainhtml.op8_html_extraction,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_minhash_forest": neardup.op10_minhash_forest,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_prefix_trie": prefixtrie.op12_prefix_trie,
    "op13_byte_bpe": bytebpe.op13_byte_bpe,
}
ORACLES: dict[str, str] = {
    "op1_sharding": sharding.OP1_SQL,
    "op2_decontamination": decontaminate.OP2_SQL,
    "op4_warc": warc.OP4_SQL,
    "op6_quality_rules": quality.OP6_SQL,
    "op12_prefix_trie": prefixtrie.OP12_SQL,
}
