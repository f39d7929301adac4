"""Queries of this subpackage for the driver, and their SQL where it can express them."""

from __future__ import annotations

from tidewater.llm import alignment, decontaminate, html_text, lexical, neighbours, ngram_join, packing, pii, quality, shards, simhash, token_files, urls

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_neighbours": neighbours.op2_neighbours,
    "op3_quality": quality.op3_quality,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_url_rules": urls.op5_url_rules,
    "op6_shards": shards.op6_shards,
    "op7_packing": packing.op7_packing,
    "op8_token_files": token_files.op8_token_files,
    "op9_main_text": html_text.op9_main_text,
    "op10_pii": pii.op10_pii,
    "op11_lexical": lexical.op11_lexical,
    "op12_alignment": alignment.op12_alignment,
    "op13_ngram_join": ngram_join.op13_ngram_join,
}
ORACLES = {"op5_url_rules": urls.ORACLE, "op11_lexical": lexical.ORACLE, "op13_ngram_join": ngram_join.ORACLE}
