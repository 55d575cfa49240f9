"""The registered corpus queries: one per operator, over the whole of its table."""

from __future__ import annotations

from . import chat, divergence, exact_dedup, langid, maxscore, mixing, near_dedup, packing, quality, repair, substring, syncmers, warc

_ALL = {
    "op1_warc_boundary_chain": (warc.op1, warc.ORACLE),
    "op2_exact_dedup_mph": (exact_dedup.op2, exact_dedup.ORACLE),
    "op3_quality_bradley_terry": (quality.op3, None),
    "op4_closed_syncmers": (syncmers.op4, None),
    "op5_order_minhash": (near_dedup.op5, None),
    "op6_langid_naive_bayes": (langid.op6, None),
    "op7_chat_perspectives": (chat.op7, chat.ORACLE),
    "op8_substring_automata": (substring.op8, substring.ORACLE),
    "op9_hash_threshold_mix": (mixing.op9, mixing.ORACLE),
    "op10_deficit_packing": (packing.op10, None),
    "op11_maxscore_topk": (maxscore.op11, maxscore.ORACLE),
    "op12_viterbi_repair": (repair.op12, repair.ORACLE),
    "op13_source_divergence": (divergence.op13, divergence.ORACLE),
}


def queries() -> dict:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
