"""Named queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from gaugeleaf.llm import byte_bpe, conversation_repair, decontamination, near_dedup, packing, periodic_runs, pii, quality_resampling, quality_rules, sharding, substring_dedup, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_pii_pseudonyms": pii.op1_pii_pseudonyms,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_packing": packing.op3_packing,
        "op4_decontamination": decontamination.op4_decontamination,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_byte_bpe": byte_bpe.op6_byte_bpe,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_quality_resampling": quality_resampling.op8_quality_resampling,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_near_dedup": near_dedup.op10_near_dedup,
        "op11_sharding": sharding.op11_sharding,
        "op12_conversation_repair": conversation_repair.op12_conversation_repair,
        "op13_periodic_runs": periodic_runs.op13_periodic_runs,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """The rest, and the pipeline, can't be stated in SQL as a whole: tests hold them against brute force, op5's rules and op9's base columns against SQL."""
    return {
        "op2_substring_dedup": substring_dedup.ORACLE,
        "op4_decontamination": decontamination.ORACLE,
        "op10_near_dedup": near_dedup.ORACLE,
        "op12_conversation_repair": conversation_repair.ORACLE,
        "op13_periodic_runs": periodic_runs.ORACLE,
    }
