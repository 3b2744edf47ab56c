"""Queries of the training-data operators, and the SQL that states their results where SQL can."""

from __future__ import annotations

from tidelog.llm import blockmax, bpe, chat, langid, mih, mixing, neardup, pii, rollup, toxicity

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_exact_top_k": blockmax.query,
    "op3_near_duplicates": neardup.query,
    "op4_nearest_neighbours": mih.query,
    "op5_language_id": langid.query,
    "op6_token_counts": rollup.query,
    "op7_byte_bpe": bpe.query,
    "op8_chat_format": chat.query,
    "op9_mix_sources": mixing.query,
    "op10_personal_data": pii.query,
}
SQL = {"op2_exact_top_k": blockmax.SQL, "op8_chat_format": chat.SQL}
