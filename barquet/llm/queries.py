"""The subpackage's registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, language_id, licences, line_dedup, media, mixing, packing, periodic_runs, pii, simhash, suffix_dedup, toxicity, vector_codes

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_line_dedup": line_dedup.op2,
    "op3_packing": packing.op3,
    "op4_pii": pii.op4,
    "op5_suffix_dedup": suffix_dedup.op5,
    "op6_media": media.op6,
    "op7_language_id": language_id.op7,
    "op8_simhash": simhash.op8,
    "op9_decontaminate": decontaminate.op9,
    "op10_licences": licences.op10,
    "op11_mixing": mixing.op11,
    "op12_vector_codes": vector_codes.op12,
    "op13_periodic_runs": periodic_runs.op13,
}

ORACLE_SQL: dict[str, str] = {"op10_licences": licences.oracle_sql(), "op11_mixing": mixing.ORACLE, "op12_vector_codes": vector_codes.oracle_sql()}
