"""Replies of layout models as rows."""

from __future__ import annotations

import ast
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.functions import text as X

# Native category, without marks and in lower case, to common category, by protocol.
CATEGORIES: dict[str, dict[str, str]] = {
    "mineru-vlm": {
        "text": "text", "asidetext": "text", "phonetic": "text", "title": "title", "table": "table", "image": "image", "code": "code", "algorithm": "code",
        "header": "header", "footer": "footer", "pagenumber": "page_number", "pagefootnote": "footnote", "tablefootnote": "footnote", "imagefootnote": "footnote",
        "equation": "equation", "equationblock": "equation", "reftext": "reference", "list": "list", "listitem": "list", "tablecaption": "caption",
        "imagecaption": "caption", "codecaption": "caption", "unknown": "unknown",
    },
    "dots-ocr": {
        "caption": "caption", "footnote": "footnote", "formula": "equation", "listitem": "list", "pagefooter": "footer", "pageheader": "header",
        "picture": "image", "sectionheader": "title", "table": "table", "text": "text", "title": "title",
    },
    "monkeyocr-v2": {
        "caption": "caption", "listitem": "list", "pagefooter": "footer", "pageheader": "header", "sectionheader": "title", "text": "text", "title": "title",
        "formula": "equation", "table": "table", "picture": "image",
    },
    "pipeline": {
        "doctitle": "title", "paragraphtitle": "title", "verticaltext": "title", "text": "text", "abstract": "text", "image": "image", "table": "table",
        "chart": "chart", "interlineequation": "equation", "list": "list", "index": "index", "header": "header", "footer": "footer", "pagenumber": "page_number",
        "footnote": "footnote", "discarded": "discarded",
    },
    "paddleocr": {"text": "text"},
}
MOST_COORDINATE = 1000
TOKENS = r"<\|box_start\|>([0-9]+)\s+([0-9]+)\s+([0-9]+)\s+([0-9]+)<\|box_end\|><\|ref_start\|>([A-Za-z0-9_]+)(?:<\|ref_end\|>)?(.*)$"
ROTATION = r"<\|rotate_(up|right|down|left)\|>"


def category_table(spark: SparkSession) -> DataFrame:
    rows = [(p, k, c) for p, own in CATEGORIES.items() for k, c in own.items()]
    return spark.createDataFrame(rows, "protocol string, key string, category string")


def with_category(blocks: DataFrame) -> DataFrame:
    """blocks (protocol, raw, ...) with category and, where no category is known, warning. The table joined has 60 rows."""
    known = category_table(blocks.sparkSession).select(F.col("protocol").alias("_p"), "key", "category")
    got = blocks.withColumn("_k", X.category_key(F.col("raw"))).join(F.broadcast(known), (F.col("protocol") == F.col("_p")) & (F.col("_k") == F.col("key")), "left")
    warning = F.when(F.col("category").isNull(), F.concat(F.lit("unrecognized category: "), F.col("raw")))
    return got.select(*blocks.columns, F.coalesce("category", F.lit("unknown")).alias("category"), warning.alias("warning"))


def layout_tokens(replies: DataFrame) -> DataFrame:
    """(doc_id, line_no, x0, y0, x1, y1, raw, rotation) of replies (doc_id, body), a box a line.

    Coordinates above 1000 are cut, corners put in order; boxes without extent and lines of another form leave
    no row.
    """
    lines = replies.select("doc_id", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    part = lambda k: F.least(F.expr(f"try_cast(regexp_extract(line, '{_quoted(TOKENS)}', {k}) AS bigint)"), F.lit(MOST_COORDINATE)).cast("int")
    got = lines.where(F.col("line").rlike(TOKENS)).select(
        "doc_id", "line_no", *[part(k + 1).alias(c) for k, c in enumerate("abcd")], F.lower(F.regexp_extract("line", TOKENS, 5)).alias("raw"),
        F.nullif(F.regexp_extract(F.regexp_extract("line", TOKENS, 6), ROTATION, 1), F.lit("")).alias("rotation"),
    )
    ordered = got.select("doc_id", "line_no", F.least("a", "c").alias("x0"), F.least("b", "d").alias("y0"), F.greatest("a", "c").alias("x1"), F.greatest("b", "d").alias("y1"), "raw", "rotation")
    return ordered.where("x1 > x0 AND y1 > y0")


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def chat_content(reply: Column) -> Column:
    """(content, truncated) of a chat completion."""
    return F.struct(F.get_json_object(reply, "$.choices[0].message.content").alias("content"), (F.get_json_object(reply, "$.choices[0].finish_reason") == "length").alias("truncated"))


_OBJECT = re.compile(r'\{[^{}]*?"bbox"\s*:\s*\[[^\]]*\][^{}]*\}', re.S)
_CELLS = "array<struct<bbox:array<double>,category:string,text:string>>"


def _as_cell(value: object) -> dict | None:
    if not isinstance(value, dict):
        return None
    box = value.get("bbox")
    if not isinstance(box, (list, tuple)) or len(box) != 4 or not all(isinstance(x, (int, float)) for x in box):
        return None
    category, text = value.get("category", value.get("label")), value.get("text")
    return {"bbox": [float(x) for x in box], "category": None if category is None else str(category), "text": None if text is None else str(text)}


def tolerant_cells(reply: str | None) -> list[dict]:
    """Cells of a reply that should be a JSON list or a Python literal, but may lack commas or its end. Repeats go."""
    reply = (reply or "").strip()
    values: list = []
    for attempt in (reply, re.sub(r"\}\s*\{", "},{", reply)):
        for read in (json.loads, ast.literal_eval):
            try:
                got = read(attempt)
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                continue
            values = got if isinstance(got, list) else [got]
            break
        if values:
            break
    else:
        for m in _OBJECT.finditer(reply):
            try:
                values.append(json.loads(m[0]))
            except ValueError:
                continue
    out, seen = [], set()
    for cell in map(_as_cell, values):
        if cell and (key := json.dumps(cell)) not in seen:
            seen.add(key)
            out.append(cell)
    return out


def json_cells(reply: Column) -> Column:
    """tolerant_cells() of a column, in Arrow batches."""
    return F.pandas_udf(_cell_series, _CELLS)(reply)


def _cell_series(reply: pd.Series) -> pd.Series:
    return reply.map(tolerant_cells)


_DEGENERATE_LEAST, _MOST_PERIOD, _LEAST_REPEATS, _LEAST_COVER = 12, 40, 5, 0.6


def is_degenerate(text: str | None) -> bool:
    """Whether some short period, repeated, covers most of a text: what a model does when it is stuck.

    For each period, the longest stretch in which every character equals the one a period before is taken.
    """
    text = text or ""
    n = len(text)
    if n < _DEGENERATE_LEAST:
        return False
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for period in range(1, max(1, min(_MOST_PERIOD, n // 4)) + 1):
        breaks = np.flatnonzero(chars[period:] != chars[:-period])
        run = int(np.diff(breaks, prepend=-1, append=n - period).max()) - 1
        repeats = (run + period) // period
        if run and repeats >= _LEAST_REPEATS and repeats * period >= n * _LEAST_COVER:
            return True
    return False


def degenerate(text: Column) -> Column:
    """is_degenerate() of a column, in Arrow batches."""
    return F.pandas_udf(_degenerate_series, "boolean")(text)


def _degenerate_series(text: pd.Series) -> pd.Series:
    return text.map(is_degenerate)
