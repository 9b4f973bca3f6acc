"""The corpus queries and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from mutagrid.llm import bpe, divergence, fill_middle, jaccard_join, language_id, mixing, nearest, ordinal, quality_rules, secret_scan, sharding, url_filter, warc

QUERIES = {
    "op1_quality": ordinal.op1_quality,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_sharding": sharding.op3_sharding,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_nearest": nearest.op5_nearest,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_mixing": mixing.op7_mixing,
    "op8_warc": warc.op8_warc,
    "op9_bpe": bpe.op9_bpe,
    "op10_secret_scan": secret_scan.op10_secret_scan,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_language": language_id.op12_language,
    "op13_divergence": divergence.op13_divergence,
    # the same operators on data that reach the depths of their methods
    "url_aliases": url_filter.url_aliases,
    "bpe_unsplit": bpe.bpe_unsplit,
    "secret_versions": secret_scan.secret_versions,
}

#: None for op1 (a fitted model), op5 (an approximate search), op9 (a tokeniser) and op12 (fitted automata): these are tested against brute force,
#: exact round trips, held-out ratings and languages.
ORACLES = {
    "op2_jaccard_join": jaccard_join.SQL,
    "op3_sharding": sharding.SQL,
    "op4_quality_rules": quality_rules.SQL,
    "op6_url_filter": url_filter.SQL,
    "op7_mixing": mixing.SQL,
    "op8_warc": warc.SQL,
    "op10_secret_scan": secret_scan.SQL,
    "op11_fill_middle": fill_middle.SQL,
    "op13_divergence": divergence.SQL,
    "url_aliases": url_filter.ALIASES_SQL,
    "bpe_unsplit": bpe.UNSPLIT_SQL,
    "secret_versions": secret_scan.VERSIONS_SQL,
}
