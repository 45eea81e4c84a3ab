"""Queries of the training-data operators, and SQL where it can express one."""

from __future__ import annotations

from taproot.llm.packing import op9_packing
from taproot.llm import bpe, conversations, decontaminate, fill_middle, fingerprints, link_graph, ngram_join, sharding, substring_dedup, surrogates, toxicity
from taproot.llm.token_files import op3_token_files

QUERIES = {
    "op10_pii_surrogates": surrogates.op10_pii_surrogates,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_url_filter": link_graph.op2_url_filter,
    "op6_sharding": sharding.op6_sharding,
    "op4_toxicity": toxicity.op4_toxicity,
    "op8_ngram_jaccard_join": ngram_join.op8_ngram_jaccard_join,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op3_token_files": op3_token_files,
    "op9_packing": op9_packing,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_bpe": bpe.op13_bpe,
}
ORACLE_SQL: dict[str, str] = {
    "op8_ngram_jaccard_join": ngram_join.ORACLE_SQL,
    "op5_substring_dedup": substring_dedup.ORACLE_SQL,
    "op11_fill_middle": fill_middle.ORACLE_SQL,
    "op12_conversation_repair": conversations.ORACLE_SQL,
}
