"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from tessera.llm import chat_format, exact_dedup, licenses, mixing, near_duplicates, order_minhash, packing, quality, secrets, toxicity

QUERIES = {
    "op2_licenses": licenses.op2_licenses,
    "op8_mixing": mixing.op8_mixing,
    "op1_near_duplicates": near_duplicates.op1_near_duplicates,
    "op6_toxicity": toxicity.op6_toxicity,
    "op3_quality": quality.op3_quality,
    "op10_order_minhash": order_minhash.op10_order_minhash,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_secrets": secrets.op5_secrets,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op9_packing": packing.op9_packing,
}

ORACLE_SQL = {
    "op8_mixing": mixing.OP8_SQL,
    "op1_near_duplicates": near_duplicates.OP1_SQL,
    "op4_chat_format": chat_format.OP4_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
}
