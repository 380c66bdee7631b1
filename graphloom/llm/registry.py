"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from graphloom.llm import decontaminate, divergence, egojoin, langid, lexical, licenses, lm, minhash, packing, quality, sentencepiece, sharding, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.query,
        "op2_language_id": langid.query,
        "op3_embedding_near_dedup": egojoin.query,
        "op4_decontamination": decontaminate.query,
        "op5_sentencepiece": sentencepiece.query,
        "op6_sharding": sharding.query,
        "op7_license_scan": licenses.query,
        "op8_quality": quality.query,
        "op9_lm_score": lm.query,
        "op10_minhash_near_dedup": minhash.query,
        "op11_best_fit_packing": packing.query,
        "op12_lexical_search": lexical.query,
        "op13_source_divergence": divergence.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_near_dedup": egojoin.oracle(), "op7_license_scan": licenses.oracle(), "op10_minhash_near_dedup": minhash.oracle(), "op12_lexical_search": lexical.oracle(), "op13_source_divergence": divergence.oracle()}
