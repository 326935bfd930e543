"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, conversation_trie, decontaminate, hard_negatives, html_text, lattice_lm, licenses, near_dups, packing, quality_classifier, quality_rules, secrets, token_store


def queries() -> dict:
    return {
        "op1_secrets": secrets.op1_secrets,
        "op2_html_text": html_text.op2_html_text,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_lattice_lm": lattice_lm.op4_lattice_lm,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_bpe": bpe.op6_bpe,
        "op7_near_dups": near_dups.op7_near_dups,
        "op8_token_store": token_store.op8_token_store,
        "op9_licenses": licenses.op9_licenses,
        "op10_quality_classifier": quality_classifier.op10_quality_classifier,
        "op11_packing": packing.op11_packing,
        "op12_conversation_trie": conversation_trie.op12_conversation_trie,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict:
    return {"op9_licenses": licenses.oracle()}
