"""The registered queries of this folder and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelathe.llm import ann, fingerprints, html_text, licences, mixing, ngram_join, packing, quality, token_tables, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_warc": warc.op3_warc,
    "op4_packing": packing.op4_packing,
    "op5_licences": licences.op5_licences,
    "op6_mixing": mixing.op6_mixing,
    "op7_token_tables": token_tables.op7_token_tables,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_ann": ann.op9_ann,
    "op10_html_text": html_text.op10_html_text,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": ngram_join.OP2_SQL,
    "op3_warc": warc.OP3_SQL,
    "op5_licences": licences.OP5_SQL,
}
