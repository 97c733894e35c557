"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textpool.llm import (decontam, embed_dedup, filter_audit, html_extract, langid, line_dedup, mixing, ngram_join, pii, spelling,
                          tool_chat, url_filter, warc)
from textpool.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


@_query("op1_mix_sources", mixing.SQL)
def op1(spark, d):
    return mixing.mixing_digest(spark, read_table(spark, d, "documents", "doc_id", "source", "text"))


@_query("op2_url_filter")
def op2(spark, d):
    return url_filter.judge_urls(spark, read_table(spark, d, "pages", "page_id", "url", "html"))


@_query("op3_embedding_dedup")
def op3(spark, d):
    return embed_dedup.near_vectors(spark, read_table(spark, d, "embeddings", "vec_id", "embedding", "label"))


@_query("op4_decontaminate")
def op4(spark, d):
    return decontam.contamination_digest(spark, read_table(spark, d, "documents", "doc_id", "text"),
                                         read_table(spark, d, "benchmark", "item_id", "text"))


@_query("op5_personal_data")
def op5(spark, d):
    return pii.pii_digest(spark, read_table(spark, d, "documents", "doc_id", "text"))


@_query("op6_main_text")
def op6(spark, d):
    return html_extract.extract(spark, read_table(spark, d, "pages", "page_id", "url", "html"))


@_query("op7_jaccard_join")
def op7(spark, d):
    return ngram_join.near_copies(spark, read_table(spark, d, "documents", "doc_id", "text"))


@_query("op8_language_id")
def op8(spark, d):
    return langid.langid_digest(spark, read_table(spark, d, "documents", "doc_id", "text", "lang"))


@_query("op9_tool_calls", tool_chat.SQL)
def op9(spark, d):
    return tool_chat.tool_chat_digest(spark, read_table(spark, d, "conversations", "conv_id", "turn", "role", "text"))


@_query("op10_line_dedup", line_dedup.SQL)
def op10(spark, d):
    return line_dedup.line_dedup_digest(spark, read_table(spark, d, "documents", "doc_id", "text"))


@_query("op11_spelling_variants", spelling.SQL)
def op11(spark, d):
    return spelling.spelling_variants(spark, read_table(spark, d, "documents", "doc_id", "text"))


@_query("op12_filter_audit", filter_audit.SQL)
def op12(spark, d):
    return filter_audit.audit_filters(spark, read_table(spark, d, "documents", "doc_id", "text", "source"),
                                      read_table(spark, d, "labels", "doc_id", "quality", "toxic"))


@_query("op13_warc_revisits", warc.SQL)
def op13(spark, d):
    return warc.archive_digest(spark, read_table(spark, d, "pages", "page_id", "url", "html"))
