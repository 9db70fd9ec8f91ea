"""Driver queries of the eight problems."""

from __future__ import annotations

from scriptoria.llm.answers import p3_counts, p3_found
from scriptoria.llm.functions import p4_found, p4_pairs
from scriptoria.llm.handwritten import p2_found, p2_handwritten, p2_kinds
from scriptoria.llm.handwritten import sql as handwritten_sql
from scriptoria.llm.mixing import p7_mix, p7_shares
from scriptoria.llm.residue import p1_found, p1_kinds, p1_sound_manual
from scriptoria.llm.sentences import p8_found, p8_lengths
from scriptoria.llm.splitting import p5_found, p5_pieces
from scriptoria.llm.tokenizer import p6_ids, p6_length_histogram

QUERIES = {
    "p1_found": p1_found,
    "p1_kinds": p1_kinds,
    "p1_sound_manual": p1_sound_manual,
    "p2_found": p2_found,
    "p2_kinds": p2_kinds,
    "p2_handwritten": p2_handwritten,
    "p3_found": p3_found,
    "p3_counts": p3_counts,
    "p4_found": p4_found,
    "p4_pairs": p4_pairs,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p6_ids": p6_ids,
    "p6_length_histogram": p6_length_histogram,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_lengths": p8_lengths,
}

SQL: dict[str, str] = {
    "p2_found": handwritten_sql("SELECT DISTINCT module_id FROM judged WHERE kind <> 'handwritten'"),
    "p2_kinds": handwritten_sql("SELECT module_id, min(kind) AS kind FROM judged GROUP BY module_id"),
    "p2_handwritten": handwritten_sql("SELECT DISTINCT module_id FROM judged WHERE kind = 'handwritten'"),
    "p5_found": (
        "SELECT DISTINCT 'snippet' AS item_kind, CAST(evidence_id AS VARCHAR) AS item_id FROM evidence JOIN size_limits ON item_kind = 'snippet' WHERE length(snippet) > max_chars "
        "UNION ALL SELECT DISTINCT 'source', module_id FROM modules JOIN size_limits ON item_kind = 'source' WHERE length(source) > max_chars"
    ),
}
