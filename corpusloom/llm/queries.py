"""The queries of this subpackage, by operator number."""

from __future__ import annotations

from corpusloom.llm import brown, decontaminate, language, packing, pii, quality, simhash, suffix, token_files, toxicity

QUERIES = {
    "op9_lm_scoring": brown.op9_lm_scoring,
    "op1_suffix_array_dedup": suffix.op1_suffix_array_dedup,
    "op2_language_id": language.op2_language_id,
    "op6_token_files": token_files.op6_token_files,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op10_pii": pii.op10_pii,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
}
ORACLE_SQL: dict[str, str] = {"op1_suffix_array_dedup": suffix.OP1_SQL, "op5_benchmark_decontamination": decontaminate.OP5_SQL}
