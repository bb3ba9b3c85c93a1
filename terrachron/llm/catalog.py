"""Registered queries of this subpackage and their oracle SQL."""

from . import (
    collocations,
    exact_dedup,
    html_extract,
    jaccard_join,
    lexical_search,
    license_scan,
    packing,
    piece_codec,
    quality_model,
    quality_rules,
    suffix_dedup,
    toxicity,
    url_filters,
)

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_html_extract": html_extract.op2_html_extract,
    "op3_quality_model": quality_model.op3_quality_model,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_packing": packing.op6_packing,
    "op7_url_filters": url_filters.op7_url_filters,
    "op8_piece_codec": piece_codec.op8_piece_codec,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_collocations": collocations.op12_collocations,
    "op13_license_scan": license_scan.op13_license_scan,
}
ORACLES = {
    "op4_quality_rules": quality_rules.SQL,
    "op7_url_filters": url_filters.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_lexical_search": lexical_search.SQL,
    "op12_collocations": collocations.SQL,
    "op13_license_scan": license_scan.SQL,
}
