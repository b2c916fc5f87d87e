"""The queries of this subpackage, by the names under which they are registered."""

from __future__ import annotations

from . import decontaminate, fingerprints, licences, line_dedup, near_dedup, packing, quality, sharding, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_licence_scan": licences.query,
    "op3_minhash_near_dedup": near_dedup.query,
    "op4_quality_classifier": quality.query,
    "op5_warc": warc.query,
    "op6_sharding": sharding.query,
    "op7_benchmark_decontamination": decontaminate.query,
    "op8_line_dedup": line_dedup.query,
    "op9_fingerprints": fingerprints.query,
    "op10_best_fit_packing": packing.query,
}

ORACLE_SQL = {"op3_minhash_near_dedup": near_dedup.SQL, "op5_warc": warc.SQL, "op8_line_dedup": line_dedup.SQL}
