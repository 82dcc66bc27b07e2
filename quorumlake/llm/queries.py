"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

from . import lexical_search, line_dedup, phrase_mining

_QUERIES = {
    "op4_pfair_mixing": "mixing",
    "op8_length_packing": "packing",
    "op5_setsketch_dedup": "near_dedup",
    "op9_embedding_dedup": "embedding_dedup",
    "op6_language_id": "language_id",
    "op7_quality_classifier": "quality_classifier",
    "op1_line_dedup": "line_dedup",
    "op2_quality_rules": "quality_rules",
    "op3_secret_scan": "secret_scan",
    "op10_hilbert_sharding": "sharding",
    "op11_phrase_collocations": "phrase_mining",
    "op12_vector_packing": "vector_packing",
    "op13_lexical_search": "lexical_search",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op11_phrase_collocations": phrase_mining.SQL, "op13_lexical_search": lexical_search.SQL}
