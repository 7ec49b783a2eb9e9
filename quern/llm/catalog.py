"""Registered queries of the training-data operators, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import chat, crf_html, debruijn, exact_dedup, hilbert_ann, langid, packing, pfair, simhash, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_debruijn_dedup": debruijn.op2_debruijn_dedup,
        "op3_retrieval_packing": packing.op3_retrieval_packing,
        "op4_hilbert_neighbours": hilbert_ann.op4_hilbert_neighbours,
        "op5_crf_html": crf_html.op5_crf_html,
        "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_pfair_mix": pfair.op8_pfair_mix,
        "op9_chat_repair": chat.op9_chat_repair,
        "op10_language_id": langid.op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.ORACLE, "op2_debruijn_dedup": debruijn.ORACLE}
