"""The queries and oracles of this subpackage."""

from __future__ import annotations

from importlib import import_module

#: query name -> module and function of this subpackage.
_QUERIES = {
    "op1_toxicity": ("toxicity", "op1_toxicity"),
    "op2_embedding_near_dedup": ("rptree", "op2_embedding_near_dedup"),
    "op3_source_mix": ("mixing", "op3_source_mix"),
    "op4_katz_lm": ("katz", "op4_katz_lm"),
    "op5_language_id": ("langid", "op5_language_id"),
    "op6_substring_dedup": ("substrings", "op6_substring_dedup"),
    "op7_token_files": ("tokenfiles", "op7_token_files"),
    "op8_exact_top_k": ("topk", "op8_exact_top_k"),
    "op9_byte_bpe": ("bpe", "op9_byte_bpe"),
    "op10_simhash_near_dedup": ("simhash", "op10_simhash_near_dedup"),
    "op11_bin_slack_packing": ("packing", "op11_bin_slack_packing"),
    "op12_token_alignment": ("alignment", "op12_token_alignment"),
    "op13_filter_audit": ("filters", "op13_filter_audit"),
}


def _call(module: str, name: str):
    return lambda spark, sf_dir: getattr(import_module(f".{module}", __package__), name)(spark, sf_dir)


def queries() -> dict:
    return {k: _call(*v) for k, v in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_top_k": import_module(".topk", __package__).OP8_SQL, "op13_filter_audit": import_module(".filters", __package__).OP13_SQL}
