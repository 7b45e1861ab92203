"""The corpus queries, one for each operator, and their SQL."""

from __future__ import annotations

from . import decontamination, embedding_dedup, line_dedup, mixing, pii, quality, secrets, sharding, simhash, toxicity


def queries() -> dict:
    return {
        "op1_hilbert_sharding": sharding.op1_hilbert_sharding,
        "op2_simhash_gray": simhash.op2_simhash_gray,
        "op3_pii_surrogates": pii.op3_pii_surrogates,
        "op4_secret_links": secrets.op4_secret_links,
        "op5_quality_cotraining": quality.op5_quality_cotraining,
        "op6_toxic_segments": toxicity.op6_toxic_segments,
        "op7_decontamination": decontamination.op7_decontamination,
        "op8_mixing": mixing.op8_mixing,
        "op9_embedding_pca": embedding_dedup.op9_embedding_pca,
        "op10_line_runs": line_dedup.op10_line_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_mixing": mixing.ORACLE_SQL,
        "op10_line_runs": line_dedup.ORACLE_SQL,
    }
