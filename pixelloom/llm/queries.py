"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import centroid_clustering, chat_format, decontamination, jaccard_join, license_scan, lm_scoring, merkle_manifest, mixing, quality_classifier, quality_rules, sharding, suffix_dedup, toxicity

QUERIES = {
    "op1_quality_classifier": quality_classifier.op1_quality_classifier,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_mixing": mixing.op4_mixing,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_hilbert_sharding": sharding.op8_hilbert_sharding,
    "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_centroid_clustering": centroid_clustering.op12_centroid_clustering,
    "op13_merkle_manifest": merkle_manifest.op13_merkle_manifest,
}
SQL = {
    "op2_suffix_dedup": suffix_dedup.OP2_SQL,
    "op3_decontamination": decontamination.OP3_SQL,
    "op5_jaccard_join": jaccard_join.OP5_SQL,
    "op6_chat_format": chat_format.OP6_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
    "op10_license_scan": license_scan.OP10_SQL,
    "op12_centroid_clustering": centroid_clustering.OP12_SQL,
    "op13_merkle_manifest": merkle_manifest.OP13_SQL,
}
