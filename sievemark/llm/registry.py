"""The corpus operators' queries by name, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import decontam, exact_dedup, filter_audit, fingerprints, language, license_scan, lm_score, packing, prefix_trie, quality, sharding, simhash, suffix_dedup


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_quality": quality.op3_quality,
        "op4_language": language.op4_language,
        "op5_lm_score": lm_score.op5_lm_score,
        "op6_fingerprints": fingerprints.op6_fingerprints,
        "op7_decontamination": decontam.op7_decontamination,
        "op8_simhash": simhash.op8_simhash,
        "op9_packing": packing.op9_packing,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_exact_dedup": exact_dedup.op12_exact_dedup,
        "op13_filter_audit": filter_audit.op13_filter_audit,
    }


def oracle_sql() -> dict:
    return {
        "op2_license_scan": license_scan.ORACLE,
        "op7_decontamination": decontam.ORACLE,
        "op10_suffix_dedup": suffix_dedup.ORACLE,
        "op11_prefix_trie": prefix_trie.ORACLE,
        "op12_exact_dedup": exact_dedup.ORACLE,
        "op13_filter_audit": filter_audit.ORACLE,
    }
