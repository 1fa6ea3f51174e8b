"""Registered queries over what pages show, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.functions import geometry as G
from pagelathe.functions import lines as L
from pagelathe.operators import evidence as E
from pagelathe.plans.inputs import INPUT_SQL, read
from pagelathe.plans.text_queries import q


def underlined_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "items")
    rules = read(spark, sf_dir, "regions").select("doc_id", "page", F.col("x0").alias("x"), (F.col("y0") - 1).alias("y"), F.lit(200.0).alias("width"), (F.col("region_id") % 3).cast("double").alias("height"))
    return E.underlined(items, rules).select("doc_id", "page", "item_no")


UNDERLINED_ITEMS_SQL = f"""
WITH r AS (SELECT doc_id, page, x0 AS x, y0 - 1 AS y, CAST(200 AS DOUBLE) AS width, CAST(region_id % 3 AS DOUBLE) AS height FROM {INPUT_SQL['regions']})
SELECT doc_id, page, item_no FROM {INPUT_SQL['items']} i WHERE EXISTS (SELECT 1 FROM r WHERE i.doc_id = r.doc_id AND i.page = r.page AND r.height <= 2 AND r.y + r.height BETWEEN i.y - 3 AND i.y + 1
  AND least(i.x + i.width, r.x + r.width) - greatest(i.x, r.x) >= i.width * 0.6)
"""


def items_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.outside(read(spark, sf_dir, "items"), read(spark, sf_dir, "regions")).select("doc_id", "page", "item_no")


ITEMS_OUTSIDE_SQL = f"""
SELECT doc_id, page, item_no FROM {INPUT_SQL['items']} i WHERE NOT EXISTS (SELECT 1 FROM {INPUT_SQL['regions']} r WHERE i.doc_id = r.doc_id AND i.page = r.page AND i.x + i.width / 2 BETWEEN r.x0 AND r.x1 AND i.y + i.height / 2 BETWEEN r.y0 AND r.y1)
"""


def _bands(items: DataFrame, n: int, step: float) -> DataFrame:
    docs = items.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("band"))
    return docs.withColumn("low", F.col("band") * F.lit(step)).withColumn("high", F.col("low") + step)


def items_in_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "items").withColumn("text", F.trim("text"))
    return E.in_grid(items, _bands(items, 8, 90.0), _bands(items, 6, 100.0))


ITEMS_IN_GRID_SQL = f"""
WITH p AS (SELECT *, floor((y + height / 2) / 90) AS r, floor((x + width / 2) / 100) AS c FROM {INPUT_SQL['items']})
SELECT doc_id, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, count(*) AS n, string_agg(trim(text), ' ' ORDER BY page, x, item_no) AS text FROM p WHERE r BETWEEN 0 AND 7 AND c BETWEEN 0 AND 5 GROUP BY ALL
"""


def column_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = _bands(read(spark, sf_dir, "items"), 6, 110.0).select("doc_id", F.col("band").alias("anchor"), F.col("low").alias("x"))
    return E.nearest_anchor(read(spark, sf_dir, "items"), anchors, 50.0)


COLUMN_ANCHORS_SQL = f"""
WITH a AS (SELECT range AS anchor, CAST(range * 110 AS DOUBLE) AS ax FROM range(6)), n AS (SELECT doc_id, item_no, anchor, row_number() OVER (PARTITION BY doc_id, item_no ORDER BY abs(x - ax), anchor) AS k FROM {INPUT_SQL['items']}, a WHERE abs(x - ax) <= 50)
SELECT doc_id, item_no, CAST(anchor AS INT) AS anchor FROM n WHERE k = 1
"""


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = E.resized(F.col("n") * 9 + 5, F.col("n") * 7 % 900 + 3)
    b = E.rescaled(G.box(F.col("n"), F.col("n"), F.col("n") * 2, F.col("n") * 3), F.lit(0.5), F.col("n") % 3)
    return read(spark, sf_dir, "values").select("id", r["width"].alias("width"), r["height"].alias("height"), b["x1"].alias("x1"), b["y1"].alias("y1"), F.array_join(E.sampled_pages(F.col("n"), 8).cast("array<string>"), ",").alias("pages"))


SIZES_SQL = f"""
WITH v AS (SELECT id, n, CAST(n * 9 + 5 AS DOUBLE) AS w, CAST(n * 7 % 900 + 3 AS DOUBLE) AS h FROM {INPUT_SQL['values']}), r AS (SELECT *, greatest(28, round(w / 28) * 28) AS a, greatest(28, round(h / 28) * 28) AS b FROM v)
SELECT id, CAST(CASE WHEN a * b > 11289600 THEN floor(w / sqrt(w * h / 11289600.0) / 28) * 28 WHEN a * b < 3136 THEN ceil(w * sqrt(3136.0 / (w * h)) / 28) * 28 ELSE a END AS INT) AS width,
  CAST(CASE WHEN a * b > 11289600 THEN floor(h / sqrt(w * h / 11289600.0) / 28) * 28 WHEN a * b < 3136 THEN ceil(h * sqrt(3136.0 / (w * h)) / 28) * 28 ELSE b END AS INT) AS height,
  CAST(n * 4 AS INT) AS x1, CAST(round(CAST(n * 3 AS DOUBLE) / nullif(n % 3, 0)) AS INT) AS y1,
  array_to_string(CASE WHEN n <= 8 THEN range(1, n + 1) ELSE list_sort(list_distinct(list_concat([1, n], list_transform(range(1, 7), lambda k: 1 + k * ((n - 2) // 7))))) END, ',') AS pages FROM r
"""


def data_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "values").select("id", E.is_data_like(F.col("value")).alias("data"), E.is_data_like(F.concat(F.lit("("), F.col("n").cast("string"), F.lit(")"))).alias("bracketed"))


_T = f"regexp_replace(value, {q(L.TRIM)}, '', 'g')"
DATA_LIKE_SQL = f"""
WITH v AS (SELECT id, {_T} AS t FROM {INPUT_SQL['values']})
SELECT id, t <> '' AND ((regexp_matches(t, '^[0-9.,+-]+$') AND regexp_matches(t, '[0-9]')) OR (strlen(t) <= 10 AND len(regexp_extract_all(t, '[0-9]')) >= 4 AND regexp_matches(t, '[/-]') AND regexp_matches(t, '^[0-9/.\\-]+$'))
  OR (strlen(t) <= 10 AND regexp_matches(t, '^[\\p{{L}}\\p{{N}}]+$') AND regexp_matches(t, '[0-9]')) OR (regexp_matches(t, '[0-9]') AND regexp_matches(t, {q(E.UNITS)})) OR regexp_matches(t, '^\\([0-9.,+-]+\\)$')) AS data, true AS bracketed FROM v
"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % 3).alias("tables"), (F.col("o_orderkey") % 4).alias("columns"), (F.col("o_orderkey") % 5 * 100).alias("text_chars"),
        (F.col("o_orderkey") % 2).alias("images"), (F.col("o_orderkey") % 11 == 0).alias("garbled"), (F.col("o_orderkey") % 13 == 0).alias("vector_text"), (F.col("o_orderkey") % 4 * 90).alias("rotation"),
    )


_PAGES = "(SELECT o_custkey AS doc_id, o_orderkey AS page, o_orderkey % 3 AS tables, o_orderkey % 4 AS columns, o_orderkey % 5 * 100 AS text_chars, o_orderkey % 2 AS images, o_orderkey % 11 = 0 AS garbled, o_orderkey % 13 = 0 AS vector_text, o_orderkey % 4 * 90 AS rotation FROM orders)"


def page_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    shape = E.layout_complexity(pages).select("doc_id", F.size("pages_with_tables").alias("with_tables"), F.size("pages_with_columns").alias("with_columns"), "is_complex")
    return shape.join(E.content_mix(pages), "doc_id")


PAGE_PROFILES_SQL = f"""
WITH g AS (SELECT doc_id, CAST(count(*) FILTER (tables > 0) AS INT) AS with_tables, CAST(count(*) FILTER (columns > 1) AS INT) AS with_columns, count(*) FILTER (tables > 0) / count(*) AS table_share, count(*) FILTER (tables = 0 AND text_chars > 0) / count(*) AS text_share FROM {_PAGES} GROUP BY 1)
SELECT *, with_tables > 0 OR with_columns > 0 AS is_complex, CASE WHEN table_share > 0.5 THEN 'table_dense' WHEN text_share > 0.7 THEN 'text_dominant' ELSE 'mixed' END AS mix FROM g
"""


def ocr_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ocr_reasons(_pages(spark, sf_dir)).select("doc_id", "page", F.array_join("reasons", ",").alias("reasons"))


OCR_REASONS_SQL = f"""
SELECT * FROM (SELECT doc_id, page, concat_ws(',', CASE WHEN garbled THEN 'garbled' END, CASE WHEN vector_text THEN 'vector_text' END, CASE WHEN text_chars = 0 AND images = 0 THEN 'no_text' END, CASE WHEN text_chars = 0 AND images > 0 THEN 'scanned' END) AS reasons FROM {_PAGES}) WHERE reasons <> ''
"""


def rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.page_rotation(_pages(spark, sf_dir).withColumn("page", F.col("page") % 2))


ROTATIONS_SQL = f"""
WITH v AS (SELECT doc_id, page % 2 AS page, rotation, count(*) AS n FROM {_PAGES} GROUP BY ALL)
SELECT doc_id, page, first(rotation ORDER BY n DESC, rotation) AS rotation FROM v GROUP BY ALL
"""


def contents_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.contents_runs(_pages(spark, sf_dir).select("doc_id", F.col("page").alias("line_no"), F.col("text_chars").alias("page_number")))


CONTENTS_RUNS_SQL = f"""
WITH n AS (SELECT *, CASE WHEN text_chars < lag(text_chars) OVER (PARTITION BY doc_id ORDER BY page) THEN 1 ELSE 0 END AS new FROM {_PAGES}), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY page) AS run FROM n)
SELECT doc_id, CAST(run AS BIGINT) AS run, min(page) AS first_line, count(*) AS entries FROM r GROUP BY ALL
"""


def heading_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "orders").select(
        F.floor(F.col("o_orderkey") / 40).alias("doc_id"), F.col("o_orderkey").alias("line_no"), F.when(F.col("o_custkey") % 3 > 0, F.floor(F.col("o_custkey") % 3)).alias("level"), F.col("o_orderstatus").alias("text")
    )
    return E.merged_headings(lines)


HEADING_GROUPS_SQL = """
WITH l AS (SELECT CAST(floor(o_orderkey / 40) AS BIGINT) AS doc_id, o_orderkey AS line_no, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 3 END AS level, o_orderstatus AS text FROM orders),
n AS (SELECT *, CASE WHEN level = lag(level) OVER w AND line_no = lag(line_no) OVER w + 1 THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM n)
SELECT doc_id, min(line_no) AS first_line, min(level) AS level, string_agg(text, ' ' ORDER BY line_no) AS text FROM r WHERE level IS NOT NULL GROUP BY doc_id, run
"""


def isolated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "items").select("doc_id", "page", F.col("item_no").alias("line_no"), "y")
    return E.isolated_lines(lines, 30.0)


ISOLATED_LINES_SQL = f"""
WITH l AS (SELECT doc_id, page, item_no AS line_no, y, lag(y) OVER w - y AS up, y - lead(y) OVER w AS down FROM {INPUT_SQL['items']} WINDOW w AS (PARTITION BY doc_id, page ORDER BY item_no))
SELECT doc_id, page, line_no, y FROM l WHERE coalesce(up > 30, true) AND coalesce(down > 30, true)
"""

QUERIES = {
    f.__name__: f
    for f in (underlined_items, items_outside, items_in_grid, column_anchors, sizes, data_like, page_profiles, ocr_reasons, rotations, contents_runs, heading_groups, isolated_lines)
}
ORACLE_SQL = {name: globals()[f"{name.upper()}_SQL"] for name in QUERIES if f"{name.upper()}_SQL" in globals()}
