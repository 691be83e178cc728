"""The subpackage's queries by name, and SQL for those that SQL can express."""

from quillmark.llm import chat_format, decontaminate, exact_dedup, importance, merkle, mixing, near_dedup, quality, substring_dedup, suffix_dedup, token_output, toxicity, url_filter

QUERIES = {
    "op1_token_output": token_output.op1_token_output,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_quality": quality.op5_quality,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_url_filter": url_filter.op13_url_filter,
}
ORACLES = {
    "op2_chat_format": chat_format.SQL,
    "op3_near_dedup": near_dedup.SQL,
    "op4_suffix_dedup": suffix_dedup.SQL,
    "op6_decontaminate": decontaminate.SQL,
    "op7_substring_dedup": substring_dedup.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op10_mix_sources": mixing.SQL,
    "op11_importance_resampling": importance.SQL,
    "op12_merkle_manifest": merkle.SQL,
    "op13_url_filter": url_filter.SQL,
}
