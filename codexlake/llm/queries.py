"""All queries on training data and the SQL they are held against."""

from __future__ import annotations

from codexlake.llm import cross_split, grouped_split, leaks, lookalikes, mixing, privacy, sentences

QUERIES = {
    "p2_found": lookalikes.p2_found,
    "p2_line_forms": lookalikes.p2_line_forms,
    "p3_found": privacy.p3_found,
    "p3_redacted": privacy.p3_redacted,
    "p4_found": cross_split.p4_found,
    "p4_same_text": cross_split.p4_same_text,
    "p4_overlap": cross_split.p4_overlap,
    "p5_found": grouped_split.p5_found,
    "p5_codices": grouped_split.p5_codices,
    "p5_assignment": grouped_split.p5_assignment,
    "p5_split_report": grouped_split.p5_split_report,
    "p7_found": leaks.p7_found,
    "p7_paraphrases": leaks.p7_paraphrases,
    "p8_mixture": mixing.p8_mixture,
    "p8_shares": mixing.p8_shares,
    "p8_full_shares": mixing.p8_full_shares,
    "p9_found": sentences.p9_found,
}

ORACLES: dict[str, str] = {
    "p5_found": grouped_split.P5_SQL,
    "p5_codices": grouped_split.CODICES_SQL,
    "p4_same_text": cross_split.SAME_TEXT_SQL,
}
