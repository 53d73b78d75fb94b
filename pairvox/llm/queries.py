"""Queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pairvox.llm import bpe, divergence, itq_dedup, jaccard_join, license_scan, line_dedup, packing, pieces, prefix_trie, quality, sharding, suffix_dedup, transport_stream

QUERIES = {
    "op1_interleave_shards": sharding.query,
    "op2_transport_stream": transport_stream.query,
    "op3_suffix_array_dedup": suffix_dedup.query,
    "op4_site_line_dedup": line_dedup.query,
    "op5_license_scan": license_scan.query,
    "op6_minimum_slack_packing": packing.query,
    "op7_itq_near_vectors": itq_dedup.query,
    "op8_rank_queue_bpe": bpe.query,
    "op9_grouped_prefix_join": jaccard_join.query,
    "op10_cotrained_quality": quality.query,
    "op11_range_minimum_trie": prefix_trie.query,
    "op12_score_agenda_pieces": pieces.query,
    "op13_digest_divergence": divergence.query,
}

ORACLE_SQL = {
    "op1_interleave_shards": sharding.ORACLE_SQL,
    "op3_suffix_array_dedup": suffix_dedup.ORACLE_SQL,
    "op4_site_line_dedup": line_dedup.ORACLE_SQL,
    "op7_itq_near_vectors": itq_dedup.ORACLE_SQL,
    "op9_grouped_prefix_join": jaccard_join.ORACLE_SQL,
    "op11_range_minimum_trie": prefix_trie.ORACLE_SQL,
    "op13_digest_divergence": divergence.ORACLE_SQL,
}
