"""The queries of this package, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import mixing, packing, quality_rules, ranking, records, simhash, substring_dedup, suffix_dedup, topk, toxicity


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_suffix": suffix_dedup.op2_suffix,
        "op3_topk": topk.op3_topk,
        "op4_packing": packing.op4_packing,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_substring": substring_dedup.op6_substring,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_simhash": simhash.op8_simhash,
        "op9_ranking": ranking.op9_ranking,
        "op10_records": records.op10_records,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix": suffix_dedup.ORACLE, "op3_topk": topk.ORACLE, "op6_substring": substring_dedup.ORACLE}
