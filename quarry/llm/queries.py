"""The registered query of each training-data operator, and its SQL where SQL can express it."""

from __future__ import annotations

from quarry.llm import langid, lines, lm, media, mixing, neardup, pieces, pii, repeats, topk

QUERIES = {
    "op1_repeats": repeats.op1_repeats,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_media": media.op3_media,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_pii": pii.op5_pii,
    "op6_mixing": mixing.op6_mixing,
    "op7_top_k": topk.op7_top_k,
    "op8_lm_scores": lm.op8_lm_scores,
    "op9_language_id": langid.op9_language_id,
    "op10_near_dedup": neardup.op10_near_dedup,
}

ORACLES: dict[str, str] = {"op7_top_k": topk.ORACLE}
