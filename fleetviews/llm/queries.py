"""The queries of this package and their oracle statements, as the driver entry registers them."""

from __future__ import annotations

from . import (
    chat, exact_dedup, licences, lm_scoring, mixing, packing, pieces, pii, quality, repair, repeats, simhash, vector_codes,
)

QUERIES = {
    f.__name__: f
    for f in (
        exact_dedup.op1_exact_dedup,
        repeats.op2_suffix_dedup,
        simhash.op3_simhash,
        chat.op4_chat_format,
        lm_scoring.op5_lm_scoring,
        quality.op6_quality_rules,
        licences.op7_license_scan,
        mixing.op8_mixing,
        packing.op9_packing,
        pii.op10_pii,
        repair.op11_conversation_repair,
        vector_codes.op12_vector_codes,
        pieces.op13_sentencepiece,
    )
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op4_chat_format": chat.OP4_SQL,
    "op7_license_scan": licences.OP7_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
}
