"""Registered queries of the operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, codes, contamination, embeddings, html, language, lines, minhash, mixing, quality, substrings, urls, whitening

_MODULES = {"op1_mixing": mixing, "op2_html_extraction": html, "op3_embedding_near_dedup": embeddings, "op4_url_filter": urls,
            "op5_line_dedup": lines, "op6_language_id": language, "op7_minhash_near_dedup": minhash,
            "op8_decontamination": contamination, "op9_chat_rotation": chat,
            "op10_substring_dedup": substrings, "op11_vector_codes": codes,
            "op12_quality_rules": quality, "op13_embedding_whitening": whitening}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)}
