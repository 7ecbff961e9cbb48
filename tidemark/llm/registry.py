"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tidemark.llm import decontaminate, exact, html, katz, licenses, mixing, neardup, quality, secrets, sharding, toxicity, trie, whiten

QUERIES = {
    "op1_html": html.op1_html,
    "op2_quality": quality.op2_quality,
    "op3_sharding": sharding.op3_sharding,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_katz": katz.op5_katz,
    "op6_secrets": secrets.op6_secrets,
    "op7_mixing": mixing.op7_mixing,
    "op8_licenses": licenses.op8_licenses,
    "op9_neardup": neardup.op9_neardup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_exact": exact.op11_exact,
    "op12_whiten": whiten.op12_whiten,
    "op13_trie": trie.op13_trie,
}
SQL = {
    "op2_quality": quality.OP2_SQL,
    "op3_sharding": sharding.OP3_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op11_exact": exact.OP11_SQL,
    "op13_trie": trie.OP13_SQL,
}
