"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from cohortpulse.llm import contamination, conversations, counts, grace, lm, mixing, packing, planes, quality, runs, simhash, suffixes, topk

QUERIES = {
    f.__name__: f
    for f in (
        grace.op10_grace_dedup,
        planes.op5_plane_ids,
        packing.op9_packing,
        simhash.op3_simhash,
        quality.op6_quality,
        mixing.op4_mixing,
        topk.op8_topk,
        counts.op2_token_counts,
        lm.op7_lm_scoring,
        suffixes.op1_suffix_dedup,
        runs.op11_periodic_runs,
        contamination.op12_decontamination,
        conversations.op13_conversations,
    )
}
ORACLES = {"op10_grace_dedup": grace.SQL, "op8_topk": topk.SQL, "op12_decontamination": contamination.SQL}
