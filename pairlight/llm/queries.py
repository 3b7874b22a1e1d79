"""Registry of this package's queries and their oracle SQL."""

from __future__ import annotations

from pairlight.llm import base_columns, boosting, bottom_k, chat, debruijn, fertility, fim, jpeg, merkle, mixing, ngram_join, pii_crf, piece_bpe, secret_scan

QUERIES = {
    "op1_tokenizer_fertility": fertility.op1_tokenizer_fertility,
    "op2_pareto_mix": mixing.op2_pareto_mix,
    "op3_debruijn_dedup": debruijn.op3_debruijn_dedup,
    "op4_incremental_rendering": chat.op4_incremental_rendering,
    "op5_skip_chain_crf": pii_crf.op5_skip_chain_crf,
    "op6_sentencepiece_backtracking": piece_bpe.op6_sentencepiece_backtracking,
    "op7_minhash_ngram_join": ngram_join.op7_minhash_ngram_join,
    "op8_baseline_jpeg": jpeg.op8_baseline_jpeg,
    "op9_gradient_boosting": boosting.op9_gradient_boosting,
    "op10_secret_randomness": secret_scan.op10_secret_randomness,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_bottom_k_sketches": bottom_k.op13_bottom_k_sketches,
    "base_quality_counts": base_columns.base_quality_counts,
    "base_personal_spans": base_columns.base_personal_spans,
    "base_secret_spans": base_columns.base_secret_spans,
}
ORACLES = {
    "op2_pareto_mix": mixing.ORACLE,
    "op11_fill_in_middle": fim.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
    "base_quality_counts": base_columns.QUALITY_SQL,
    "base_personal_spans": base_columns.PERSONAL_SQL,
    "base_secret_spans": base_columns.SECRET_SQL,
}
