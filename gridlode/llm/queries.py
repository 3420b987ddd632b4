"""Registered queries of this subpackage, and the DuckDB SQL of those that SQL can express."""

from gridlode.llm import collocations, decontaminate, fill_in_middle, html_extract, language_model, licenses, line_dedup, mixing, near_duplicates, quality_rules, sentence_pieces, toxicity, url_filters

QUERIES = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_near_dedup": near_duplicates.op3_near_dedup,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_lm_score": language_model.op6_lm_score,
    "op7_mixing": mixing.op7_mixing,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_url_filters": url_filters.op10_url_filters,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_sentence_pieces": sentence_pieces.op12_sentence_pieces,
    "op13_collocations": collocations.op13_collocations,
}
ORACLE = {
    "op2_license_scan": licenses.OP2_SQL,
    "op3_near_dedup": near_duplicates.OP3_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op8_quality_rules": quality_rules.OP8_SQL,
    "op10_url_filters": url_filters.OP10_SQL,
    "op11_fill_in_middle": fill_in_middle.OP11_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
