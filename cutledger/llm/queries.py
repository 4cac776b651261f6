"""The registered queries of this subpackage, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cutledger.llm import chat, exact, html, language, lines, mix, near, pack, quality, ranked, records, rules, variants
from cutledger.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_exact_dedup": lambda spark, d: exact.query(documents(spark, d)),
    "op2_chat_format": lambda spark, d: chat.query(spark, documents(spark, d, "conversations")),
    "op3_html_text": lambda spark, d: html.query(documents(spark, d, "pages")),
    "op4_quality_rules": lambda spark, d: rules.query(documents(spark, d)),
    "op5_language_id": lambda spark, d: language.query(documents(spark, d)),
    "op6_token_records": records.query,
    "op7_mix_sources": lambda spark, d: mix.query(documents(spark, d)),
    "op8_pack_sequences": lambda spark, d: pack.query(documents(spark, d)),
    "op9_quality_neighbours": lambda spark, d: quality.query(documents(spark, d), documents(spark, d, "labels")),
    "op10_near_dedup": lambda spark, d: near.query(documents(spark, d)),
    "op11_ranked_search": lambda spark, d: ranked.query(documents(spark, d), documents(spark, d, "benchmark")),
    "op12_line_dedup": lambda spark, d: lines.query(documents(spark, d)),
    "op13_spelling_variants": lambda spark, d: variants.query(documents(spark, d)),
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": exact.SQL,
    "op2_chat_format": chat.SQL,
    "op4_quality_rules": rules.SQL,
    "op7_mix_sources": mix.SQL,
    "op11_ranked_search": ranked.SQL,
    "op12_line_dedup": lines.SQL,
}
