"""Queries of the operators for training data."""

from __future__ import annotations

from tesserae.llm import bpe, canonical, collapse, consolidate, cube, grouped_split, language, mixing, overlap

QUERIES = {
    "p1_found": cube.p1_found,
    "p1_sample": cube.p1_sample,
    "p1_report": cube.p1_report,
    "p1_check": cube.p1_check,
    "p2_found": grouped_split.p2_found,
    "p2_assignment": grouped_split.p2_assignment,
    "p2_report": grouped_split.p2_report,
    "p2_check": grouped_split.p2_check,
    "p3_found": canonical.p3_found,
    "p3_report": canonical.p3_report,
    "p5_found": overlap.p5_found,
    "p5_report": overlap.p5_report,
    "p6_found": collapse.p6_found,
    "p6_copies": collapse.p6_copies,
    "p7_found": consolidate.p7_found,
    "p7_group_sizes": consolidate.p7_group_sizes,
    "p8_ids": bpe.p8_ids,
    "p8_token_counts": bpe.p8_token_counts,
    "p9_mix": mixing.p9_mix,
    "p9_report": mixing.p9_report,
    "p10_found": language.p10_found,
    "p10_languages": language.p10_languages,
}
