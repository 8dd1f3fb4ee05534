"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, exact_search, forest, graph_search, langid, lines, mixing, negatives, packing, passages, repeats, spelling, warc

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_warc_index": warc.op2_warc_index,
    "op3_near_duplicates": forest.op3_near_duplicates,
    "op4_source_mix": mixing.op4_source_mix,
    "op5_repeated_passages": passages.op5_repeated_passages,
    "op6_chat_format": chat.op6_chat_format,
    "op7_exact_top_k": exact_search.op7_exact_top_k,
    "op8_graph_search": graph_search.op8_graph_search,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_best_fit_pack": packing.op10_best_fit_pack,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_suffix_dedup": repeats.op13_suffix_dedup,
}
ORACLES = {
    "op2_warc_index": warc.OP2_SQL,
    "op4_source_mix": mixing.OP4_SQL,
    "op6_chat_format": chat.OP6_SQL,
    "op7_exact_top_k": exact_search.OP7_SQL,
    "op9_line_dedup": lines.OP9_SQL,
    "op12_hard_negatives": negatives.OP12_SQL,
}
