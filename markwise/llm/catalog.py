"""Queries of this subpackage and the SQL they are checked against."""

from markwise.llm.chunked_encoding import op2_byte_pair_encoding
from markwise.llm.jaccard_join import OP11_SQL, op11_ngram_jaccard_join
from markwise.llm.language_mixture import op7_language_id
from markwise.llm.language_model import op9_language_model
from markwise.llm.near_duplicates import OP6_SQL, op6_near_duplicates
from markwise.llm.packing import op4_packing
from markwise.llm.periodic_runs import op12_periodic_runs
from markwise.llm.quality_rules import op1_quality_rules
from markwise.llm.site_style_tree import op3_html_extraction
from markwise.llm.token_alignment import op13_token_alignment
from markwise.llm.viterbi_counts import op10_token_counts
from markwise.llm.warc_source import OP8_SQL, op8_warc
from markwise.llm.weighted_fingerprints import op5_document_fingerprints

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_byte_pair_encoding": op2_byte_pair_encoding,
    "op3_html_extraction": op3_html_extraction,
    "op4_packing": op4_packing,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_language_id": op7_language_id,
    "op8_warc": op8_warc,
    "op9_language_model": op9_language_model,
    "op10_token_counts": op10_token_counts,
    "op11_ngram_jaccard_join": op11_ngram_jaccard_join,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {
    "op6_near_duplicates": OP6_SQL,
    "op8_warc": OP8_SQL,
    "op11_ngram_jaccard_join": OP11_SQL,
}
