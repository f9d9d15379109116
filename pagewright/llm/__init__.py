"""Operators for training-data pipelines. Nothing outside this subpackage imports it."""

from __future__ import annotations


def queries() -> dict:
    from . import decontamination, html_text, langid, licenses, minhash, mixing, packing, prefix_trie, quality_rules, substring_dedup, toxicity, warc

    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_language_id": langid.op2_language_id,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_licenses": licenses.op4_licenses,
        "op5_minhash": minhash.op5_minhash,
        "op6_suffix_array": substring_dedup.op6_suffix_array,
        "op7_decontamination": decontamination.op7_decontamination,
        "op8_mixing": mixing.op8_mixing,
        "op9_warc": warc.op9_warc,
        "op10_html_text": html_text.op10_html_text,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_packing": packing.op12_packing,
    }


def oracle_sql() -> dict:
    from . import prefix_trie, warc

    return {"op9_warc": warc.ORACLE_SQL, "op11_prefix_trie": prefix_trie.ORACLE_SQL}
