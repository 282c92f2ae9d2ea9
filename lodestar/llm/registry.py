"""Queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import chat, decontaminate, html_extract, kneser_ney, langid, media, merkle, mixing, ngram_join, simhash, substrings, token_ids, treaps


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_kneser_ney": kneser_ney.op1_kneser_ney,
        "op2_leaks": decontaminate.op2_leaks,
        "op3_html_text": html_extract.op3_html_text,
        "op4_perspectives": chat.op4_perspectives,
        "op5_language": langid.op5_language,
        "op6_substrings": substrings.op6_substrings,
        "op7_mixing": mixing.op7_mixing,
        "op8_token_ids": token_ids.op8_token_ids,
        "op9_simhash": simhash.op9_simhash,
        "op10_webp": media.op10_webp,
        "op11_merkle": merkle.op11_merkle,
        "op12_ngram_join": ngram_join.op12_ngram_join,
        "op13_treaps": treaps.op13_treaps,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_perspectives": chat.OP4_SQL, "op11_merkle": merkle.OP11_SQL, "op12_ngram_join": ngram_join.OP12_SQL, "op13_treaps": treaps.OP13_SQL}
