"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import conversation_repair, decontaminate, exact_dedup, hard_negatives, jaccard_join, language_id, sentence_pieces, set_sketch, sharding, substring_dedup, token_files, toxicity, url_filter

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_extendible_shards": sharding.op2_extendible_shards,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_language_id": language_id.op4_language_id,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_sentence_pieces": sentence_pieces.op6_sentence_pieces,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_minhash_dedup": set_sketch.op11_minhash_dedup,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
ORACLES = {
    "op2_extendible_shards": sharding.OP2_SQL,
    "op3_substring_dedup": substring_dedup.OP3_SQL,
    "op5_url_filter": url_filter.OP5_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op8_jaccard_join": jaccard_join.OP8_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op11_minhash_dedup": set_sketch.OP11_SQL,
    "op12_conversation_repair": conversation_repair.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
