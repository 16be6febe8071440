"""The package's queries and their SQL."""

from . import chat_format, exact_dedup, language_model, line_dedup, merkle, ngram_join, packing, quality, secrets, source_mix, substring_dedup, token_alignment, topk_search

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_secrets": secrets.op2_secrets,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_source_mix": source_mix.op4_source_mix,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_packing": packing.op6_packing,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_language_model": language_model.op9_language_model,
    "op10_topk_search": topk_search.op10_topk_search,
    "op11_chat_format": chat_format.op11_chat_format,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}
ORACLE_SQL = {
    "op5_line_dedup": line_dedup.SQL,
    "op7_ngram_join": ngram_join.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op10_topk_search": topk_search.SQL,
    "op11_chat_format": chat_format.SQL,
    "op12_merkle_manifest": merkle.SQL,
}
