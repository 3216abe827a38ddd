"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, exact_dedup, html_text, language, licences, pieces, simhash, token_store, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.query,
        "op2_decontaminate": decontaminate.query,
        "op3_sentencepiece": pieces.query,
        "op4_url_filter": urls.query,
        "op5_language": language.query,
        "op6_token_ids": token_store.query,
        "op7_toxicity": toxicity.query,
        "op8_exact_dedup": exact_dedup.query,
        "op9_licences": licences.query,
        "op10_html_text": html_text.query,
        # op5 once more, over a table that has markup languages and address suffixes
        "pages_language": language.pages_query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": decontaminate.SQL, "op4_url_filter": urls.sql(), "op8_exact_dedup": exact_dedup.SQL}
