"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, licenses, linededup, mixing, neardup, phrases, prefixtrie, substrings, tokenids, tokens, topk, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_substrings": substrings.op3_substrings,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_chat": chat.op5_chat,
    "op6_topk": topk.op6_topk,
    "op7_neardup": neardup.op7_neardup,
    "op8_mixing": mixing.op8_mixing,
    "op9_licenses": licenses.op9_licenses,
    "op9_notices": licenses.op9_notices,
    "op10_linededup": linededup.op10_linededup,
    "op10_passages": linededup.op10_passages,
    "op11_prefix_trie": prefixtrie.op11_prefix_trie,
    "op12_token_ids": tokenids.op12_token_ids,
    "op13_phrases": phrases.op13_phrases,
}
ORACLES = {
    "op4_decontamination": decontaminate.ORACLE,
    "op5_chat": chat.ORACLE,
    "op6_topk": topk.ORACLE,
    "op7_neardup": neardup.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op9_licenses": licenses.ORACLE,
    "op9_notices": licenses.ORACLE_NOTICES,
    "op10_linededup": linededup.ORACLE,
    "op10_passages": linededup.ORACLE_PASSAGES,
    "op11_prefix_trie": prefixtrie.ORACLE,
    "op13_phrases": phrases.ORACLE,
}
