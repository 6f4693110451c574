"""Named queries of this package: (spark, table folder) -> DataFrame, and the SQL statements of those that SQL can express."""

from __future__ import annotations

from . import op01_topk, op02_lines, op03_simhash, op04_toxicity, op05_mixing, op06_bpe, op07_quality, op08_merkle, op09_chat, op10_pii, op11_runs, op12_whitening, op13_secrets

QUERIES = {
    "op1_exact_topk": op01_topk.op1_exact_topk,
    "op2_line_dedup": op02_lines.op2_line_dedup,
    "op3_simhash_near_dedup": op03_simhash.op3_simhash_near_dedup,
    "op4_toxicity": op04_toxicity.op4_toxicity,
    "op5_source_mixing": op05_mixing.op5_source_mixing,
    "op6_byte_bpe": op06_bpe.op6_byte_bpe,
    "op7_quality": op07_quality.op7_quality,
    "op8_merkle_fingerprint": op08_merkle.op8_merkle_fingerprint,
    "op9_preference_format": op09_chat.op9_preference_format,
    "op10_pii": op10_pii.op10_pii,
    "op11_periodic_runs": op11_runs.op11_periodic_runs,
    "op12_whitening": op12_whitening.op12_whitening,
    "op13_secrets": op13_secrets.op13_secrets,
}

STATEMENTS = {**op01_topk.SQL, **op09_chat.SQL}
