"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import ctw, jaccard, langid, licences, mixing, oracles, packing, pii, quality, sharding, topk

QUERIES = {f.__name__: f for f in (langid.op1_language_fusion, quality.op2_robust_outliers, sharding.op5_stratified_shards, packing.op3_cost_balanced_packing, topk.op4_uniform_threshold, pii.op6_feistel_pseudonyms, licences.op7_licence_paragraphs, jaccard.op8_ngram_jaccard, ctw.op9_context_tree_weighting, mixing.op10_source_schedule)}

ORACLES: dict[str, str] = {
    "op4_uniform_threshold": topk.ORACLE, "op5_stratified_shards": oracles.SHARDS, "op8_ngram_jaccard": oracles.JACCARD, "op10_source_schedule": oracles.MIXING,
}
