"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from planforge.llm import bpe_automaton, chain_dedup, exact_dedup, hard_negatives, kdtree_search, langid, lexical_search, mixing, near_dedup, packing, secret_scan, suffix_dedup, toxicity


def queries() -> dict:
    return {
        "op1_minhash_near_dedup": near_dedup.op1_minhash_near_dedup,
        "op2_language_id": langid.op2_language_id,
        "op3_secret_scan": secret_scan.op3_secret_scan,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op7_topk_search": kdtree_search.op7_topk_search,
        "op8_mix_sources": mixing.op8_mix_sources,
        "op9_substring_dedup": chain_dedup.op9_substring_dedup,
        "op10_suffix_array_dedup": suffix_dedup.op10_suffix_array_dedup,
        "op11_lexical_search": lexical_search.op11_lexical_search,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_bpe_codec": bpe_automaton.op13_bpe_codec,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": exact_dedup.OP4_SQL, "op7_topk_search": kdtree_search.OP7_SQL, "op11_lexical_search": lexical_search.OP11_SQL, "op12_hard_negatives": hard_negatives.OP12_SQL}
