"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from quillspark.llm import ann_forest, collocation, factorization, language_id, packing, quality_rules, quality_sql, role_repair, secret_scan, secret_sql, sentencepiece_codec, simhash, token_file, warc, weighted_sampling


def queries() -> dict:
    """One query for each operator."""
    return {
        "pipeline": corpus_pipeline.run,
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_warc_roundtrip": warc.op2_warc_roundtrip,
        "op3_pattern_packing": packing.op3_pattern_packing,
        "op4_simhash_dedup": simhash.op4_simhash_dedup,
        "op5_secret_scan": secret_scan.op5_secret_scan,
        "op6_quality_classifier": factorization.op6_quality_classifier,
        "op7_language_id": language_id.op7_language_id,
        "op8_sentencepiece": sentencepiece_codec.op8_sentencepiece,
        "op9_ann_forest": ann_forest.op9_ann_forest,
        "op10_token_file": token_file.op10_token_file,
        "op11_fingerprints": weighted_sampling.op11_fingerprints,
        "op12_collocations": collocation.op12_collocations,
        "op13_role_repair": role_repair.op13_role_repair,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those queries that SQL can express."""
    return {"op1_quality_rules": quality_sql.OP1, "op5_secret_scan": secret_sql.OP5, **warc.ORACLE_SQL, **collocation.ORACLE_SQL}
