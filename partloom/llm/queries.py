"""The corpus queries and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from partloom.llm import (
    collocations, decontaminate, jaccard_join, language_id, license_scan, line_dedup, nearest, piece_lattice, quality, secrets, sharding, suffix_dedup, whitening,
)


def queries() -> dict:
    return {
        "op1_sentencepiece": piece_lattice.op1_sentencepiece,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_jaccard_join": jaccard_join.op3_jaccard_join,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_license_scan": license_scan.op5_license_scan,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_quality": quality.op7_quality,
        "op8_sharding": sharding.op8_sharding,
        "op9_language_id": language_id.op9_language_id,
        "op10_nearest": nearest.op10_nearest,
        "op11_collocations": collocations.op11_collocations,
        "op12_whitening": whitening.op12_whitening,
        "op13_secrets": secrets.op13_secrets,
    }


def oracle_sql() -> dict:
    return {"op5_license_scan": license_scan.ORACLE, "op11_collocations": collocations.ORACLE}
