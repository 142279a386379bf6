"""Operators of a training-data pipeline.  Nothing else in the library imports this package."""

from drainwatch.llm.bottom_sketch import OP3_SQL, op3_minhash_near_dedup
from drainwatch.llm.chat_format import OP11_SQL, op11_chat_formatting
from drainwatch.llm.compress_quality import op2_quality_classifier
from drainwatch.llm.licence_sentences import OP5_SQL, op5_license_scans
from drainwatch.llm.line_rules import op7_quality_rules
from drainwatch.llm.mixing import OP1_SQL, op1_source_mixing
from drainwatch.llm.phrase_automata import OP4_SQL, op4_substring_dedup
from drainwatch.llm.piece_lattice import op8_sentencepiece
from drainwatch.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from drainwatch.llm.site_style import op6_html_extraction
from drainwatch.llm.sorted_projection import OP9_SQL, op9_embedding_near_dedup
from drainwatch.llm.token_prefix import op10_token_counts
from drainwatch.llm.turn_repair import OP13_SQL, op13_structure_repair

QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_license_scans": op5_license_scans,
    "op6_html_extraction": op6_html_extraction,
    "op7_quality_rules": op7_quality_rules,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_structure_repair": op13_structure_repair,
}
ORACLE = {
    "op1_source_mixing": OP1_SQL,
    "op3_minhash_near_dedup": OP3_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op5_license_scans": OP5_SQL,
    "op9_embedding_near_dedup": OP9_SQL,
    "op11_chat_formatting": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_structure_repair": OP13_SQL,
}
