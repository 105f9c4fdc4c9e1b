"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from symbolith.llm import answers, encoding, mixing, packing, pairs, provenance, validity

QUERIES = {
    "p1_found": pairs.p1_found,
    "p1_pairs": pairs.p1_pairs,
    "p2_found": answers.p2_found,
    "p2_templates": answers.p2_templates,
    "p4_found": validity.p4_found,
    "p4_errors": validity.p4_errors,
    "p4_rates": validity.p4_rates,
    "p5_found": provenance.p5_found,
    "p5_origins": provenance.p5_origins,
    "p7_packed": packing.p7_packed,
    "p7_each_window": packing.p7_each_window,
    "p7_fill": packing.p7_fill,
    "p7_documents": packing.p7_documents,
    "p8_repeats": mixing.p8_repeats,
    "p8_drawn": mixing.p8_drawn,
    "p8_shares": mixing.p8_shares,
    "p9_found": encoding.p9_found,
    "p9_restored": encoding.p9_restored,
}
#: Properties that packing and mixing must have, whatever the sizes in tokens.
ORACLES: dict[str, str] = {
    "p7_documents": "SELECT DISTINCT doc_id, 1::BIGINT AS times, true AS fits FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL",
    "p8_repeats": """SELECT DISTINCT lower(trim(d.source)) AS source, true AS within, true AS once_a_turn FROM documents d JOIN mix_targets t ON lower(trim(d.source)) = lower(trim(t.source))
WHERE d.text <> '' AND d.doc_id IS NOT NULL AND t.target_share > 0 AND t.max_repeats > 0""",
}
