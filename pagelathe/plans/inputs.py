"""Inputs of the registered queries.

The tables hold no boxes, cells, formulas or page numbers; these are made from relational columns, by expressions
that Spark and DuckDB read alike. INPUT_SQL[name] is the same table for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_EXPR: dict[str, tuple[str, dict[str, str]]] = {
    "boxes": ("orders", {
        "doc_id": "o_custkey", "page": "CAST(o_orderkey % 2 AS INT)", "idx": "CAST(o_orderkey AS INT)",
        "x0": "CAST(o_orderkey * 37 % 400 AS INT)", "y0": "CAST(o_orderkey * 53 % 500 AS INT)",
        "x1": "CAST(o_orderkey * 37 % 400 AS INT) + 20 + CAST(o_orderkey % 90 AS INT)", "y1": "CAST(o_orderkey * 53 % 500 AS INT) + 10 + CAST(o_orderkey % 40 AS INT)",
        "category": "CASE WHEN o_orderkey % 5 = 0 THEN 'title' ELSE 'text' END", "text": "concat('t', CAST(o_orderkey AS STRING))",
    }),
    "items": ("orders", {
        "doc_id": "CAST(floor(o_orderkey / 60) AS BIGINT)", "page": "CAST(floor(o_orderkey % 60 / 20) AS INT)", "item_no": "o_orderkey",
        "text": "CASE WHEN o_orderkey % 9 = 5 THEN '  ' ELSE concat('w', CAST(o_custkey % 1000 AS STRING)) END",
        "x": "CAST(o_orderkey * 31 % 560 AS DOUBLE)", "y": "CAST(o_custkey % 50 * 14 + o_orderkey % 2 AS DOUBLE)", "width": "CAST(10 + o_orderkey % 7 * 6 AS DOUBLE)",
        "height": "CAST(8 + o_orderkey % 3 * 2 AS DOUBLE)", "font_size": "CAST(8 + o_orderkey % 4 * 2 AS DOUBLE)", "is_bold": "o_orderkey % 7 = 0",
    }),
    "regions": ("orders", {
        "doc_id": "CAST(floor(o_orderkey / 60) AS BIGINT)", "page": "CAST(floor(o_orderkey % 60 / 20) AS INT)", "region_id": "o_orderkey",
        "x0": "CAST(o_custkey % 300 AS DOUBLE)", "y0": "CAST(o_custkey % 400 AS DOUBLE)", "x1": "CAST(o_custkey % 300 + 150 AS DOUBLE)", "y1": "CAST(o_custkey % 400 + 90 AS DOUBLE)",
    }),
    "cells": ("orders", {
        "doc_id": "CAST(floor(o_orderkey / 12) AS BIGINT)", "row": "CAST(floor(o_orderkey % 12 / 3) AS INT)", "col": "CAST(o_orderkey % 3 AS INT)",
        "text": "CASE WHEN o_orderkey % 12 < 3 THEN concat('a|', o_orderstatus) WHEN o_custkey % 3 = 0 THEN CAST(o_custkey AS STRING) WHEN o_custkey % 11 = 0 THEN '' ELSE concat('<', o_orderpriority, '>') END",
        "repeat": "CAST(1 + o_custkey % 3 AS INT)",
    }),
    "merges": ("customer", {"doc_id": "c_custkey", "r0": "0", "c0": "0", "r1": "CAST(c_custkey % 3 AS INT)", "c1": "CAST(c_custkey % 4 AS INT)"}),
    "latex": ("part", {
        "id": "p_partkey",
        "latex": "concat(repeat('{', CAST(p_partkey % 3 AS INT)), repeat(concat(chr(92), 'left('), CAST(p_size % 2 AS INT)), ' x_', CAST(p_size AS STRING), repeat('}', CAST(p_size % 3 AS INT)),"
        " repeat(concat(chr(92), 'right)'), CAST(p_partkey % 2 AS INT)), ' ', repeat(concat(chr(92), 'quad '), CAST(p_partkey % 4 AS INT)), 'y ', chr(92), 'eqno(', CAST(p_partkey AS STRING), ')')",
    }),
    "replies": ("lineitem", {
        "doc_id": "l_orderkey * 10 + l_linenumber", "protocol": "CASE WHEN l_partkey % 4 = 0 THEN 'mineru-vlm' WHEN l_partkey % 4 = 1 THEN 'dots-ocr' WHEN l_partkey % 4 = 2 THEN 'monkeyocr-v2' ELSE 'pipeline' END",
        "raw": "CASE WHEN l_suppkey % 7 = 0 THEN 'List-item' WHEN l_suppkey % 7 = 1 THEN ' table' WHEN l_suppkey % 7 = 2 THEN 'doc_title' WHEN l_suppkey % 7 = 3 THEN 'Formula' WHEN l_suppkey % 7 = 4 THEN 'page_number' WHEN l_suppkey % 7 = 5 THEN 'Text' ELSE 'odd one' END",
        "body": "concat('<|box_start|>', CAST(l_partkey % 1200 AS STRING), ' ', CAST(l_suppkey % 500 AS STRING), ' ', CAST(l_orderkey % 1100 AS STRING), ' ', CAST(CAST(l_quantity AS BIGINT) * 9 AS STRING), '<|box_end|><|ref_start|>Text',"
        " CASE WHEN l_linenumber % 2 = 0 THEN '<|ref_end|>' ELSE '' END, CASE WHEN l_linenumber % 3 = 0 THEN '<|rotate_left|>' ELSE '' END, chr(10), 'no box here')",
    }),
    "page_lines": ("lineitem", {
        "doc_id": "CAST(floor(l_orderkey / 90) AS BIGINT)", "page": "CAST(l_orderkey % 9 AS INT)", "line_no": "l_orderkey * 10 + l_linenumber",
        "text": "CASE WHEN l_linenumber = 1 THEN concat('Annual report of the company ', CAST(l_orderkey % 9 AS STRING)) WHEN l_linenumber = 2 THEN concat('Page ', CAST(l_orderkey % 9 AS STRING)) ELSE concat('body of the line ', CAST(l_partkey AS STRING), ' x') END",
        "y": "CASE WHEN l_linenumber = 1 THEN CAST(780 AS DOUBLE) ELSE CAST(l_partkey % 700 AS DOUBLE) END",
    }),
    "text_lines": ("orders", {
        "doc_id": "o_custkey", "line_no": "o_orderkey",
        "line": "CASE WHEN (o_orderkey + o_custkey) % 8 = 0 THEN CAST(o_orderkey % 1000 AS STRING) WHEN (o_orderkey + o_custkey) % 8 = 1 THEN '' WHEN (o_orderkey + o_custkey) % 8 = 2 THEN concat('let x = ', CAST(o_orderkey AS STRING), ';')"
        " WHEN (o_orderkey + o_custkey) % 8 = 3 THEN concat('• item ', CAST(o_custkey AS STRING)) WHEN (o_orderkey + o_custkey) % 8 = 4 THEN '---' WHEN (o_orderkey + o_custkey) % 8 = 5 THEN concat('Figure ', CAST(o_custkey AS STRING), ' shows')"
        " WHEN (o_orderkey + o_custkey) % 8 = 6 THEN concat('Chapter .... ', CAST(o_custkey AS STRING)) ELSE concat('Page ', CAST(o_custkey AS STRING), ' of 90') END",
    }),
    "folios": ("orders", {"doc_id": "CAST(floor(o_orderkey / 30) AS BIGINT)", "page": "CAST(o_custkey % 40 AS INT)", "value": "o_custkey % 40 + o_orderkey % 3"}),
    "page_tables": ("orders", {"doc_id": "CAST(floor(o_orderkey / 50) AS BIGINT)", "page": "CAST(o_orderkey AS INT)", "cols": "CAST(2 + o_custkey % 2 AS INT)", "rows": "CAST(3 + o_orderkey % 9 AS INT)"}),
    "delimited": ("orders", {
        "id": "o_orderkey",
        "text": "concat('a', CASE WHEN o_custkey % 5 = 0 THEN ',' WHEN o_custkey % 5 = 1 THEN ';' WHEN o_custkey % 5 = 2 THEN '|' WHEN o_custkey % 5 = 3 THEN chr(9) ELSE ' ' END, 'b', chr(10),"
        " '1', CASE WHEN o_custkey % 5 = 0 THEN ',' WHEN o_custkey % 5 = 1 THEN ';' WHEN o_custkey % 5 = 2 THEN '|' WHEN o_custkey % 5 = 3 THEN chr(9) ELSE ' ' END, '2', chr(10), 'x, y', chr(10))",
    }),
    "blocks": ("orders", {
        "doc_id": "o_custkey", "page": "CAST(o_orderkey % 3 AS INT)", "reading_order": "CAST(o_orderkey AS INT)",
        "category": "CASE WHEN o_orderkey % 7 = 1 THEN 'title' WHEN o_orderkey % 7 = 2 THEN 'list' ELSE 'text' END",
        "text": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('text ', CAST(o_orderkey AS STRING)) END",
        "html": "CASE WHEN o_orderkey % 10 = 3 THEN '<table></table>' END", "latex": "CASE WHEN o_orderkey % 10 = 4 THEN 'x^2' END", "asset_path": "CASE WHEN o_orderkey % 12 = 0 THEN concat('a', CAST(o_orderkey AS STRING), '.png') END",
    }),
    "url_texts": ("part", {
        "id": "p_partkey",
        "text": "concat(CASE WHEN p_size % 5 = 0 THEN 'see ' WHEN p_size % 5 = 1 THEN '[a](' WHEN p_size % 5 = 2 THEN '[go to ' WHEN p_size % 5 = 3 THEN '[x] ' ELSE '' END, 'https://example.org/', CAST(p_partkey AS STRING),"
        " CASE WHEN p_partkey % 3 = 0 THEN '.' WHEN p_partkey % 3 = 1 THEN ') and http://b.example/q?x=1, end' ELSE '] http://c.example/;' END)",
    }),
    "runs": ("orders", {
        "doc_id": "CAST(floor(o_orderkey / 48) AS BIGINT)", "page": "CAST(floor(o_orderkey % 48 / 24) AS INT)", "line_no": "CAST(floor(o_orderkey % 24 / 4) AS INT)", "item_no": "o_orderkey",
        "x": "CAST(o_orderkey % 4 * 60 + o_custkey % 7 AS DOUBLE)",
        "y": "CAST(CASE WHEN floor(o_orderkey / 48) % 3 = 2 THEN 700 - o_orderkey * 7 % 24 * 20 ELSE 700 - floor(o_orderkey % 24 / 4) * 14 + CASE WHEN o_custkey % 5 = 0 THEN 2 ELSE 0 END END AS DOUBLE)",
        "width": "CAST(CASE WHEN floor(o_orderkey / 48) % 4 < 2 THEN 20 + o_custkey % 15 WHEN o_custkey % 8 = 0 THEN 0 WHEN o_custkey % 8 = 1 THEN 60 ELSE 20 + o_custkey % 45 END AS DOUBLE)", "height": "CAST(10 AS DOUBLE)",
        "font_size": "CAST(CASE WHEN o_custkey % 11 = 0 THEN 7 ELSE 10 + o_orderkey % 3 END AS DOUBLE)", "font": "CASE WHEN o_custkey % 6 = 0 THEN 'C2_0' WHEN o_custkey % 6 = 1 THEN 'Arial-Bold' ELSE 'Times' END",
        "is_bold": "o_custkey % 6 = 1", "is_italic": "o_custkey % 9 = 2", "is_underline": "o_custkey % 13 = 3", "rotated": "o_custkey % 3 > 0", "mcid": "CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 24 END",
        "text": "CASE WHEN floor(o_orderkey / 48) % 4 = 0 THEN CASE WHEN o_custkey % 4 = 0 THEN 'plain' WHEN o_custkey % 4 = 1 THEN 'q' ELSE 'w o r d' END WHEN floor(o_orderkey / 48) % 4 = 1 AND o_custkey % 3 > 0 THEN 'k'"
        " WHEN o_custkey % 20 = 0 THEN 'a' WHEN o_custkey % 20 = 1 THEN 'b c' WHEN o_custkey % 20 = 2 THEN '34,20' WHEN o_custkey % 20 = 3 THEN '8' WHEN o_custkey % 20 = 4 THEN '%' WHEN o_custkey % 20 = 5 THEN 'LCOE' WHEN o_custkey % 20 = 6 THEN 'end:' WHEN o_custkey % 20 = 7 THEN ' lead'"
        " WHEN o_custkey % 20 = 8 THEN 'tail ' WHEN o_custkey % 20 = 9 THEN '世界' WHEN o_custkey % 20 = 10 THEN '-' WHEN o_custkey % 20 = 11 THEN '(x)' WHEN o_custkey % 20 = 12 THEN '.com' WHEN o_custkey % 20 = 13 THEN 'hello world again and more' WHEN o_custkey % 20 = 14 THEN 'enterta'"
        " WHEN o_custkey % 20 = 15 THEN 'inment' WHEN o_custkey % 20 = 16 THEN '   ' WHEN o_custkey % 20 = 17 THEN 'Mixed Words here too' WHEN o_custkey % 20 = 18 THEN 'שלום עולם' ELSE 'H' END",
    }),
    "two_columns": ("orders", {
        "doc_id": "CAST(floor(o_orderkey / 100) AS BIGINT)", "page": "1", "item_no": "o_orderkey", "place": "o_orderkey % 100", "news": "floor(o_orderkey / 100) % 3 > 0",
        "x": "CAST(CASE WHEN o_orderkey % 100 = 0 THEN 50 WHEN o_orderkey % 100 % 2 = 1 THEN 50 + o_custkey % 3 ELSE 320 + o_custkey % 3 END AS DOUBLE)",
        "y": "CAST(CASE WHEN o_orderkey % 100 = 0 THEN 750 WHEN floor(o_orderkey / 100) % 3 = 0 THEN 720 - floor((o_orderkey % 100 - 1) / 2) * 40 ELSE 720 - floor((o_orderkey % 100 - 1) / 2) * 12 END AS DOUBLE)",
        "width": "CAST(CASE WHEN o_orderkey % 100 = 0 THEN 480 ELSE 200 + o_custkey % 30 END AS DOUBLE)", "height": "CAST(10 AS DOUBLE)", "font_size": "CAST(CASE WHEN o_orderkey % 100 = 0 THEN 18 ELSE 10 END AS DOUBLE)",
        "font": "'Times'", "is_bold": "o_orderkey % 100 = 0", "is_italic": "false", "is_underline": "false",
        "text": "CASE WHEN o_orderkey % 100 = 0 THEN concat('Title of paper ', CAST(o_custkey AS STRING)) WHEN o_orderkey % 100 > 24 AND floor(o_orderkey / 100) % 3 = 0 THEN '' ELSE concat('words of line ', CAST(o_orderkey AS STRING)) END",
    }),
    "rects": ("orders", {
        "doc_id": "CAST(floor(o_orderkey / 48) AS BIGINT)", "page": "CAST(floor(o_orderkey % 48 / 24) AS INT)", "rect_no": "o_orderkey", "x": "CAST(o_orderkey * 37 % 300 AS DOUBLE)", "y": "CAST(o_orderkey * 53 % 400 AS DOUBLE)",
        "width": "CAST(CASE WHEN o_custkey % 9 = 0 THEN -30 ELSE 5 + o_custkey % 60 END AS DOUBLE)", "height": "CAST(CASE WHEN o_custkey % 4 = 0 THEN 1 ELSE 3 + o_custkey % 40 END AS DOUBLE)",
    }),
    "drawn_lines": ("orders", {
        "doc_id": "CAST(floor(o_orderkey / 48) AS BIGINT)", "page": "CAST(floor(o_orderkey % 48 / 24) AS INT)", "line_no": "o_orderkey", "x1": "CAST(o_orderkey * 31 % 260 AS DOUBLE)", "x2": "CAST(o_custkey % 300 AS DOUBLE)",
        "y1": "CAST(o_orderkey % 200 AS DOUBLE)", "y2": "CAST(o_orderkey % 200 + o_custkey % 4 AS DOUBLE)", "stroke_width": "CAST(o_custkey % 4 AS DOUBLE)",
    }),
    "amounts": ("orders", {
        "doc_id": "o_custkey", "item_no": "o_orderkey", "x": "CAST(o_orderkey % 300 AS DOUBLE)", "width": "CAST(60 + o_orderkey % 7 * 60 AS DOUBLE)", "font_size": "CAST(8 + o_orderkey % 3 AS DOUBLE)",
        "text": "CASE WHEN o_orderkey % 6 = 0 THEN concat('$ ', CAST(o_custkey AS STRING), ' (1,5) — ') WHEN o_orderkey % 6 = 1 THEN concat(CAST(o_custkey AS STRING), '  2%  - $ 3') WHEN o_orderkey % 6 = 2 THEN 'Land $ 77,1 2 3' WHEN o_orderkey % 6 = 3 THEN '1 2 $' WHEN o_orderkey % 6 = 4 THEN '' ELSE '4 5' END",
    }),
    "odd_texts": ("part", {
        "id": "p_partkey",
        "text": "CASE WHEN p_partkey % 12 = 0 THEN repeat('Qrzx', 60) WHEN p_partkey % 12 = 1 THEN concat('ﬁ', 'ﬂ ', 'oﬀer') WHEN p_partkey % 12 = 2 THEN repeat('a$b', 30) WHEN p_partkey % 12 = 3 THEN concat('x', repeat('', CAST(p_size % 5 AS INT)), 'y') WHEN p_partkey % 12 = 4 THEN repeat(concat(chr(131), 'q', chr(130)), CAST(p_size % 9 AS INT))"
        " WHEN p_partkey % 12 = 5 THEN repeat('éèü', CAST(p_size % 20 AS INT)) WHEN p_partkey % 12 = 6 THEN concat('the cat ', repeat('�', CAST(p_size % 4 AS INT)), ' and the dog') WHEN p_partkey % 12 = 7 THEN concat('שלום ', p_brand, ' עולם') WHEN p_partkey % 12 = 8 THEN '世界 and 日本'"
        " WHEN p_partkey % 12 = 9 THEN repeat('wkh txlfn eurzq ira ', CAST(10 + p_size % 9 AS INT)) WHEN p_partkey % 12 = 10 THEN repeat('hJkT bDmQ ', CAST(20 + p_size % 9 AS INT)) ELSE concat('S = kB ln W, (', CAST(p_size % 30 AS STRING), ')') END",
    }),
    "ranges": ("part", {
        "id": "p_partkey", "spec": "CASE WHEN p_size % 6 = 0 THEN '' WHEN p_size % 6 = 1 THEN '5,1' WHEN p_size % 6 = 2 THEN '4-2' WHEN p_size % 6 = 3 THEN concat('1-', CAST(p_size AS STRING), ',2') WHEN p_size % 12 = 4 THEN '0' WHEN p_size % 12 = 10 THEN '3,1-999999999' ELSE concat(CAST(p_size AS STRING), ' , 3-4') END",
    }),
    "values": ("part", {"id": "p_partkey", "value": "CASE WHEN p_size % 9 = 0 THEN ' 42 ' WHEN p_size % 9 = 1 THEN '1e5' WHEN p_size % 9 = 2 THEN '.5' WHEN p_size % 9 = 3 THEN 'inf' WHEN p_size % 9 = 4 THEN '1d' WHEN p_size % 9 = 5 THEN 'TRUE' WHEN p_size % 9 = 6 THEN '' WHEN p_size % 9 = 7 THEN p_name ELSE CAST(p_size AS STRING) END", "n": "CAST(1 + p_partkey % 700 AS INT)"}),
}

INPUT_SQL = {name: f"(SELECT {', '.join(f'{e} AS {chr(34)}{c}{chr(34)}' for c, e in columns.items())} FROM {source})" for name, (source, columns) in _EXPR.items()}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table, or a made one."""
    if name not in _EXPR:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source, columns = _EXPR[name]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").select(*[F.expr(e).alias(c) for c, e in columns.items()])
