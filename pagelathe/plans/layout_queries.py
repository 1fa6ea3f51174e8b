"""Registered queries over boxes, items, cells and model replies, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.functions import geometry as G
from pagelathe.functions import lines as L
from pagelathe.operators import evidence as E
from pagelathe.operators import layout as P
from pagelathe.operators import model_output as J
from pagelathe.operators import render as R
from pagelathe.operators import tables as T
from pagelathe.plans.inputs import INPUT_SQL, read
from pagelathe.plans.text_queries import _trim, q

#: evidence.is_data_like() of {t}, a trimmed text.
E_DATA_SQL = (
    "((regexp_matches({t}, '^[0-9.,+-]+$') AND regexp_matches({t}, '[0-9]')) OR (strlen({t}) <= 10 AND len(regexp_extract_all({t}, '[0-9]')) >= 4 AND regexp_matches({t}, '[/-]') AND regexp_matches({t}, '^[0-9/.\\-]+$'))"
    " OR (strlen({t}) <= 10 AND regexp_matches({t}, '^[\\p{L}\\p{N}]+$') AND regexp_matches({t}, '[0-9]')) OR (regexp_matches({t}, '[0-9]') AND regexp_matches({t}, '" + E.UNITS + "')) OR regexp_matches({t}, '^\\([0-9.,+-]+\\)$'))"
)


def box_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = G.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    other = G.box(F.lit(100), F.lit(100), F.lit(300), F.lit(300))
    frac, clean = G.from_fraction(b, F.lit(595), F.lit(842), 1000.0), G.sanitized(b, F.lit(320), F.lit(240))
    return read(spark, sf_dir, "boxes").select(
        "doc_id", "idx", F.round(G.iou(b, other), 9).alias("iou"), *[frac[c].alias(f"p_{c}") for c in ("x0", "y0", "x1", "y1")], *[clean[c].alias(f"s_{c}") for c in ("x0", "y0", "x1", "y1")]
    )


def _px(c: str, extent: int) -> str:
    return f"CAST(round(CAST(CAST({c} AS FLOAT) / CAST(1000 AS FLOAT) AS FLOAT) * CAST({extent} AS FLOAT)) AS INT)"


_I = "(CAST(greatest(least(x1, 300) - greatest(x0, 100), 0) AS BIGINT) * greatest(least(y1, 300) - greatest(y0, 100), 0))"
BOX_MATH_SQL = f"""
SELECT doc_id, idx, round({_I} / ((x1 - x0) * (y1 - y0) + 40000 - {_I}), 9) AS iou,
  {_px('x0', 595)} AS p_x0, {_px('y0', 842)} AS p_y0, {_px('x1', 595)} AS p_x1, {_px('y1', 842)} AS p_y1,
  greatest(0, least(x0, 320)) AS s_x0, greatest(0, least(y0, 240)) AS s_y0, greatest(0, least(x1, 320)) AS s_x1, greatest(0, least(y1, 240)) AS s_y1
FROM {INPUT_SQL['boxes']}
"""


def boxes_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.keep_boxes(read(spark, sf_dir, "boxes"), 0.2)


_PAIR = "(CAST(greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) AS BIGINT) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0))"
BOXES_KEPT_SQL = f"""
WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY idx) AS k FROM {INPUT_SQL['boxes']}),
e AS (SELECT a.doc_id, a.page, a.k AS ka, b.k AS kb FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.page = b.page AND a.k < b.k
  WHERE {_PAIR} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_PAIR}) > 0.2),
g AS (SELECT doc_id, page, max(k) AS last FROM n GROUP BY ALL),
s AS (SELECT doc_id, page, 1 AS k, [CAST(1 AS BIGINT)] AS kept FROM g
  UNION ALL
  SELECT s.doc_id, s.page, s.k + 1, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.doc_id = s.doc_id AND e.page = s.page AND e.kb = s.k + 1 AND list_contains(s.kept, e.ka)) THEN s.kept ELSE list_append(s.kept, CAST(s.k + 1 AS BIGINT)) END
  FROM s JOIN g USING (doc_id, page) WHERE s.k < g.last)
SELECT n.doc_id, n.page, n.idx, n.x0, n.y0, n.x1, n.y1 FROM n JOIN g USING (doc_id, page) JOIN s ON s.doc_id = n.doc_id AND s.page = n.page AND s.k = g.last WHERE list_contains(s.kept, n.k)
"""


def gap_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.gap_bands(read(spark, sf_dir, "boxes")).select("doc_id", "page", "idx", "band")


GAP_BANDS_SQL = f"""
WITH m AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page ORDER BY x0, x1, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {INPUT_SQL['boxes']})
SELECT doc_id, page, idx, CAST(sum(CASE WHEN x0 >= before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY x0, x1, idx) AS BIGINT) AS band FROM m
"""


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.reading_order(read(spark, sf_dir, "boxes"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.merge_paragraphs(read(spark, sf_dir, "boxes"))


PARAGRAPHS_SQL = f"""
WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY idx) AS k FROM {INPUT_SQL['boxes']}),
w AS (
  SELECT doc_id, page, k, 1 AS run, idx AS first_idx, 1 AS n_merged, category, text, x0, y0, x1, y1 FROM n WHERE k = 1
  UNION ALL
  SELECT n.doc_id, n.page, n.k, CASE WHEN j THEN run ELSE run + 1 END, CASE WHEN j THEN first_idx ELSE n.idx END, CASE WHEN j THEN n_merged + 1 ELSE 1 END, n.category, CASE WHEN j THEN w.text || ' ' || n.text ELSE n.text END,
    CASE WHEN j THEN least(w.x0, n.x0) ELSE n.x0 END, CASE WHEN j THEN least(w.y0, n.y0) ELSE n.y0 END, CASE WHEN j THEN greatest(w.x1, n.x1) ELSE n.x1 END, CASE WHEN j THEN greatest(w.y1, n.y1) ELSE n.y1 END
  FROM w JOIN n ON n.doc_id = w.doc_id AND n.page = w.page AND n.k = w.k + 1,
  LATERAL (SELECT n.category = 'text' AND w.category = 'text' AND n.y0 - w.y1 BETWEEN 0 AND {P.PARAGRAPH_GAP} AND abs(n.x0 - w.x0) <= {P.PARAGRAPH_SHIFT} AS j) z),
e AS (SELECT *, max(k) OVER (PARTITION BY doc_id, page, run) AS last FROM w)
SELECT doc_id, page, first_idx, n_merged, category, text, x0, y0, x1, y1 FROM e WHERE k = last
"""


def region_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.items_in_regions(read(spark, sf_dir, "items"), read(spark, sf_dir, "regions"))


REGION_ITEMS_SQL = f"""
SELECT r.doc_id, r.page, r.region_id, count(*) AS n_items, sum(i.width) AS width FROM {INPUT_SQL['items']} i JOIN {INPUT_SQL['regions']} r
ON i.doc_id = r.doc_id AND i.page = r.page AND least(i.x + i.width, r.x1 + 1.5) > greatest(i.x, r.x0 - 1.5) AND least(i.y + i.height, r.y1 + 1.5) > greatest(i.y, r.y0 - 1.5) GROUP BY ALL
"""


def snapped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.snapped(read(spark, sf_dir, "boxes").select("doc_id", F.col("x0").cast("double").alias("value")), 20.0)


SNAPPED_EDGES_SQL = f"""
WITH v AS (SELECT doc_id, CAST(x0 AS DOUBLE) AS value FROM {INPUT_SQL['boxes']}), c AS (SELECT *, CASE WHEN value - lag(value) OVER (PARTITION BY doc_id ORDER BY value) > 20 THEN 1 ELSE 0 END AS new FROM v),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY value) AS cluster FROM c)
SELECT doc_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, min(value) AS low, max(value) AS high FROM k GROUP BY ALL
"""


def folio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.folio_pairs(read(spark, sf_dir, "folios"))


FOLIO_PAIRS_SQL = f"""
WITH f AS (SELECT * FROM {INPUT_SQL['folios']}), p AS (SELECT a.doc_id, a.page AS p1, a.value AS v1, b.page AS p2, b.value AS v2 FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.page = a.page + 1 AND b.value = a.value + 1)
SELECT doc_id, p1 AS page, v1 AS value FROM p UNION SELECT doc_id, p2, v2 FROM p
"""


def base_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.base_font_size(read(spark, sf_dir, "items"))


_BASE = f"""
  SELECT doc_id, coalesce(first(k ORDER BY n DESC, k) FILTER (k IS NOT NULL) / 10.0, {P.DEFAULT_FONT}) AS base FROM
  (SELECT doc_id, CASE WHEN font_size >= {P.LEAST_FONT} THEN CAST(floor(font_size * 10) AS BIGINT) END AS k, count(*) AS n FROM {INPUT_SQL['items']} GROUP BY ALL) GROUP BY doc_id
"""
BASE_FONTS_SQL = f"SELECT doc_id, CAST(base AS DOUBLE) AS base FROM ({_BASE})"


def font_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.font_rarity(read(spark, sf_dir, "items"))


FONT_RARITY_SQL = f"SELECT doc_id, font_size, count(*) AS items, 1 - count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS rarity FROM {INPUT_SQL['items']} GROUP BY doc_id, font_size"


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.item_lines(read(spark, sf_dir, "items"))


_ROWS = f"""
c AS (SELECT *, y + height / 2 AS c FROM {INPUT_SQL['items']} WHERE trim(text) <> ''),
f AS (SELECT *, CASE WHEN abs(c - lag(c) OVER w) > greatest(greatest(height, lag(height) OVER w) * {P.ROW_SHARE}, {P.LEAST_ROW}) THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY doc_id, page ORDER BY y DESC, x, item_no)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY y DESC, x, item_no) AS line_no FROM f),
g AS (SELECT *, x - lag(x + width) OVER (PARTITION BY doc_id, page, line_no ORDER BY x, item_no) AS gap FROM r),
rows AS (SELECT doc_id, page, CAST(line_no AS BIGINT) AS line_no, string_agg(CASE WHEN gap > font_size * {P.SPACE_SHARE} THEN ' ' ELSE '' END || text, '' ORDER BY x, item_no) AS text, max(y) AS y, max(x + width) AS "right", first(font_size ORDER BY x, item_no) AS first_size, first(is_bold ORDER BY x, item_no) AS first_bold FROM g GROUP BY ALL)
"""
TEXT_ROWS_SQL = f"WITH {_ROWS} SELECT * FROM rows"


def paragraph_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "items")
    return P.paragraph_threshold(P.item_lines(items), P.base_font_size(items)).select("doc_id", F.round("threshold", 6).alias("threshold"))


PARAGRAPH_THRESHOLDS_SQL = f"""
WITH {_ROWS}, b AS ({_BASE}), p AS (SELECT doc_id, lag(y) OVER (PARTITION BY doc_id, page ORDER BY line_no) - y AS gap FROM rows),
s AS (SELECT p.doc_id, list_sort(list(gap)) AS g FROM p JOIN b USING (doc_id) WHERE gap > 0 AND gap < base * 10 GROUP BY 1)
SELECT b.doc_id, round(coalesce(CASE WHEN len(g) >= 5 THEN greatest(g[len(g) // 2 + 1] * 1.3, base * 1.5) END, base * 1.8), 6) AS threshold FROM b LEFT JOIN s USING (doc_id)
"""


def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "items")
    base = P.base_font_size(items)
    lines = P.item_lines(items)
    joined = lines.join(base, "doc_id").join(P.heading_tiers(lines, base), "doc_id", "left")
    tiers = F.coalesce("tiers", F.array().cast("array<double>"))
    return joined.select("doc_id", "page", "line_no", P.heading_level(F.col("first_size"), F.col("base"), tiers, F.col("first_bold")).alias("level"))


#: The sizes of the made items are two points apart, so that distinct sizes are distinct tiers.
HEADING_LEVELS_SQL = f"""
WITH {_ROWS}, b AS ({_BASE}), l AS (SELECT rows.*, base, first_size / base AS ratio, trim(text) AS t FROM rows JOIN b USING (doc_id)),
z AS (SELECT doc_id, coalesce(list_sort(list(DISTINCT first_size) FILTER (ratio >= {P.TIER_RATIO} AND (t = '' OR regexp_matches(t, '\\p{{L}}'))), 'DESC'), []) AS large,
  coalesce(list_sort(list(DISTINCT first_size) FILTER (ratio >= {P.BOLD_RATIO} AND first_bold AND regexp_matches(t, '\\p{{L}}')), 'DESC'), []) AS bold FROM l GROUP BY 1),
t AS (SELECT doc_id, (CASE WHEN len(large) > 0 THEN large ELSE bold END)[1:{P.MOST_TIERS}] AS tiers FROM z),
p AS (SELECT l.*, tiers, coalesce(list_position(tiers, first_size), 0) AS near, len(tiers) AS many FROM l JOIN t USING (doc_id))
SELECT doc_id, page, line_no, CAST(CASE WHEN ratio >= {P.TIER_RATIO} THEN CASE WHEN near > 0 THEN near WHEN many = 0 THEN CASE WHEN ratio >= 2 THEN 1 WHEN ratio >= 1.5 THEN 2 WHEN ratio >= 1.25 THEN 3 ELSE 4 END WHEN ratio >= 1.5 THEN least(many + 1, 4) END
  WHEN ratio >= {P.BOLD_RATIO} AND first_bold AND near > 0 THEN near END AS INT) AS level FROM p
"""


def delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "delimited").select("id", T.sniff_delimiter(F.col("text")).alias("delimiter"))


_SCORES = ", ".join(
    f"(SELECT {{'alike': coalesce(len(list_filter(c, lambda n: n = m)), 0), 'median': m, 'place': {k}, 'mark': {q(d) if d != chr(9) else 'chr(9)'}}} FROM (SELECT c, coalesce(list_sort(c)[len(c) // 2 + 1], 0) AS m FROM"
    f" (SELECT list_filter(list_transform(r, lambda x: length(x) - length(replace(x, {q(d) if d != chr(9) else 'chr(9)'}, ''))), lambda n: n > 0) AS c)))"
    for k, d in enumerate(T.DELIMITERS)
)
DELIMITERS_SQL = f"""
WITH r AS (SELECT id, list_filter(string_split(replace(text, chr(13), ''), chr(10))[1:{T.SNIFFED_LINES}], lambda x: x <> '') AS r FROM {INPUT_SQL['delimited']})
SELECT id, list_max([{_SCORES}]).mark AS delimiter FROM r
"""


def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.header_rows(read(spark, sf_dir, "cells"))


HEADER_ROWS_SQL = f"""
SELECT doc_id, CASE WHEN max("row") > 0 AND NOT bool_or("row" = 0 AND regexp_matches(trim(text), '^[+-]?(?i:inf|infinity|nan|true|false|(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:e[+-]?[0-9]+)?)$')) THEN 1 ELSE 0 END AS header_rows FROM {INPUT_SQL['cells']} GROUP BY 1
"""


def cells_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.repeated(read(spark, sf_dir, "cells"), 24)


CELLS_REPEATED_SQL = f"""
WITH c AS (SELECT *, sum("repeat") OVER (PARTITION BY doc_id) AS n, sum("repeat") OVER (PARTITION BY doc_id, "row" ORDER BY col) - "repeat" AS f FROM {INPUT_SQL['cells']})
SELECT doc_id, "row", CAST(unnest(range(CAST(f AS BIGINT), CAST(f AS BIGINT) + "repeat")) AS INT) AS col, text, NULL AS error FROM c WHERE n <= 24
UNION ALL SELECT DISTINCT doc_id, NULL, NULL, NULL, 'limit' FROM c WHERE n > 24
"""


def merge_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.merge_warnings(read(spark, sf_dir, "cells").where("doc_id % 7 > 0 OR row < 2"), read(spark, sf_dir, "merges"))


MERGE_WARNINGS_SQL = f"""
WITH z AS (SELECT doc_id, max("row") AS rs, max(col) AS cs FROM {INPUT_SQL['cells']} WHERE doc_id % 7 > 0 OR "row" < 2 GROUP BY 1)
SELECT m.doc_id, r0, c0, r1, c1, 'merged range outside the grid' AS warning FROM {INPUT_SQL['merges']} m LEFT JOIN z USING (doc_id) WHERE coalesce(r1 > rs OR c1 > cs, true)
"""


def cells_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.merged_cells(read(spark, sf_dir, "cells"), read(spark, sf_dir, "merges")).drop("repeat")


_MERGED = f"""
WITH c AS (SELECT * FROM {INPUT_SQL['cells']}), z AS (SELECT doc_id, max("row") AS rs, max(col) AS cs FROM c GROUP BY 1),
m AS (SELECT m.* FROM {INPUT_SQL['merges']} m JOIN z USING (doc_id) WHERE r1 <= rs AND c1 <= cs),
j AS (SELECT c.*, r0, c0, r1, c1, r0 IS NULL OR ("row" = r0 AND col = c0) AS o FROM c LEFT JOIN m ON c.doc_id = m.doc_id AND "row" BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1),
g AS (SELECT doc_id, "row", col, text, CASE WHEN o THEN 'origin' ELSE 'covered' END AS slot, CASE WHEN o THEN coalesce(r1 - r0 + 1, 1) END AS row_span, CASE WHEN o THEN coalesce(c1 - c0 + 1, 1) END AS col_span,
  coalesce(r0, "row") AS origin_row, coalesce(c0, col) AS origin_col FROM j)
"""
CELLS_MERGED_SQL = f"{_MERGED} SELECT * FROM g"


def tables_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.html_tables(cells_merged(spark, sf_dir))


TABLES_HTML_SQL = f"""{_MERGED},
e AS (SELECT doc_id, "row", col, slot, CASE WHEN "row" < 1 THEN 'th' ELSE 'td' END AS t, CASE WHEN row_span > 1 THEN ' rowspan="' || row_span || '"' ELSE '' END || CASE WHEN col_span > 1 THEN ' colspan="' || col_span || '"' ELSE '' END AS s,
  replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS x FROM g),
r AS (SELECT doc_id, "row", '<tr>' || coalesce(string_agg('<' || t || s || '>' || x || '</' || t || '>', '' ORDER BY col) FILTER (slot = 'origin'), '') || '</tr>' AS line FROM e GROUP BY ALL)
SELECT doc_id, '<table>' || string_agg(line, '' ORDER BY "row") || '</table>' AS html FROM r GROUP BY 1
"""


def tables_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.markdown_tables(read(spark, sf_dir, "cells"))


TABLES_MARKDOWN_SQL = f"""
WITH r AS (SELECT doc_id, "row", count(*) AS n, '| ' || string_agg(replace(replace(text, '|', '\\|'), chr(10), '<br>'), ' | ' ORDER BY col) || ' |' AS line FROM {INPUT_SQL['cells']} GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "row") AS k, max(n) OVER (PARTITION BY doc_id) AS w FROM r)
SELECT doc_id, string_agg(CASE WHEN k = 1 THEN line || chr(10) || '|' || repeat(' --- |', CAST(w AS INT)) ELSE line END, chr(10) ORDER BY "row") AS markdown FROM n GROUP BY 1
"""


def table_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = read(spark, sf_dir, "cells")
    wide = cells.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "row", F.explode(F.sequence(F.col("col") * 7, F.col("col") * 7 + 6)).alias("col"), F.when((F.col("row") + F.col("col")) % 3 > 0, F.concat(F.upper("text"), F.lit(":"))).otherwise("").alias("text"))
    narrow = cells.where("col < 2").select((F.col("doc_id") + 2_000_000).alias("doc_id"), "row", "col", F.when(F.col("col") == 0, "Total:").otherwise(F.col("text")).alias("text"))
    grids = cells.select("doc_id", "row", "col", "text").union(wide).union(narrow)
    return T.table_checks(grids, E.is_data_like).withColumn("data_share", F.round("data_share", 9))


_D = E_DATA_SQL.replace("{t}", "trim(text)")
_C = INPUT_SQL["cells"]
TABLE_CHECKS_SQL = f"""
WITH g AS (SELECT doc_id, "row", col, text FROM {_C}
  UNION ALL SELECT doc_id + 1000000, "row", CAST(unnest(range(col * 7, col * 7 + 7)) AS INT), CASE WHEN ("row" + col) % 3 > 0 THEN upper(text) || ':' ELSE '' END FROM {_C}
  UNION ALL SELECT doc_id + 2000000, "row", col, CASE WHEN col = 0 THEN 'Total:' ELSE text END FROM {_C} WHERE col < 2),
c AS (SELECT *, trim(text) <> '' AND "row" > 0 AS v, col = 0 AND (ends_with(trim(text), ':') OR (strlen(trim(text)) > 3 AND regexp_matches(trim(text), '^[\\p{{Lu}}\\s()]+$'))) AS label FROM g),
r AS (SELECT doc_id, "row", count(*) FILTER (text <> '') AS f, count(*) FILTER (v) AS v, count(*) FILTER (v AND {_D}) AS d, count(*) FILTER (label) AS label, sum(strlen(trim(text))) FILTER (v) AS b, max(col + 1) AS c FROM c GROUP BY ALL),
m AS (SELECT doc_id, first(f ORDER BY n DESC, f DESC) AS mode FROM (SELECT doc_id, f, count(*) AS n FROM r GROUP BY ALL) GROUP BY 1),
z AS (SELECT r.*, mode, max(c) OVER (PARTITION BY doc_id) AS cols FROM r JOIN m USING (doc_id)),
t AS (SELECT doc_id, count(*) AS rows, max(cols) AS cols, sum(d) / nullif(sum(v), 0) AS share, count(*) FILTER (abs(f - mode) <= CASE WHEN cols > 15 THEN cols // 4 ELSE 2 END) / count(*) AS near, sum(v) AS v, sum(b) AS b,
  count(*) FILTER (f <= 2) > count(*) * 0.7 AND sum(label) > count(*) * 0.5 AND max(cols) <= 6 AS key_value FROM z GROUP BY 1)
SELECT doc_id, rows, cols, round(share, 9) AS data_share, rows < 3 OR near > CASE WHEN cols > 15 THEN 0.25 ELSE 0.40 END AS consistent, key_value, v > 0 AND (coalesce(share > 0.3, false) OR cols >= 3 OR (cols = 2 AND b // v <= 25)) AS table_like FROM t
"""


def continuation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.continuation_runs(read(spark, sf_dir, "page_tables"))


CONTINUATION_TABLES_SQL = f"""
WITH n AS (SELECT *, CASE WHEN page = lag(page) OVER w + 1 AND cols = lag(cols) OVER w THEN 0 ELSE 1 END AS new FROM {INPUT_SQL['page_tables']} WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY page) AS run FROM n)
SELECT doc_id, CAST(run AS BIGINT) AS run, min(page) AS first_page, max(page) AS last_page, min(cols) AS cols, CAST(sum(CASE WHEN new = 1 THEN rows ELSE greatest(rows - 2, 0) END) AS BIGINT) AS rows FROM r GROUP BY doc_id, r.run
"""


def otsl_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.when(F.col("col") == 1, F.lit("<lcel>")).when((F.col("col") == 2) & (F.col("row") == 2), F.lit("<ucel>")).otherwise(F.concat(F.lit("<fcel>"), "text"))
    rows = read(spark, sf_dir, "cells").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row", "col", cell.alias("t")))).alias("c"))
    tokens = F.array_join(F.transform("c", lambda x: F.concat(F.when((x["col"] == 0) & (x["row"] > 0), "<nl>").otherwise(""), x["t"])), "")
    return rows.select("doc_id", T.otsl_html(tokens).alias("html"))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.with_category(read(spark, sf_dir, "replies").select("doc_id", "protocol", "raw"))


_KNOWN = ", ".join(f"({q(p)}, {q(k)}, {q(c)})" for p, own in J.CATEGORIES.items() for k, c in own.items())
CATEGORIES_SQL = f"""
SELECT r.doc_id, r.protocol, r.raw, coalesce(k.category, 'unknown') AS category, CASE WHEN k.category IS NULL THEN 'unrecognized category: ' || r.raw END AS warning
FROM {INPUT_SQL['replies']} r LEFT JOIN (VALUES {_KNOWN}) k(protocol, key, category) ON r.protocol = k.protocol AND regexp_replace(lower(trim(r.raw)), '[-_ ]', '', 'g') = k.key
"""


def layout_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.layout_tokens(read(spark, sf_dir, "replies"))


_PART = lambda k: f"CAST(least(TRY_CAST(regexp_extract(line, {q(J.TOKENS)}, {k}) AS BIGINT), {J.MOST_COORDINATE}) AS INT)"
LAYOUT_BOXES_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS line_no FROM {INPUT_SQL['replies']}),
b AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, {_PART(1)} AS a, {_PART(2)} AS b, {_PART(3)} AS c, {_PART(4)} AS d, lower(regexp_extract(line, {q(J.TOKENS)}, 5)) AS raw,
  nullif(regexp_extract(regexp_extract(line, {q(J.TOKENS)}, 6), {q(J.ROTATION)}, 1), '') AS rotation FROM l WHERE regexp_matches(line, {q(J.TOKENS)}))
SELECT doc_id, line_no, least(a, c) AS x0, least(b, d) AS y0, greatest(a, c) AS x1, greatest(b, d) AS y1, raw, rotation FROM b WHERE a <> c AND b <> d
"""


def reply_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('[{"bbox": ['), F.concat_ws(",", "x0", "y0", "x1", "y1"), F.lit('], "category": "'), F.col("category"), F.lit('", "text": "'), F.col("text"), F.lit('"}'), F.when(F.col("idx") % 3 == 0, "]").otherwise('{"bbox": [1'))
    cells = read(spark, sf_dir, "boxes").select("doc_id", "idx", F.explode(J.json_cells(body)).alias("c"))
    return cells.select("doc_id", "idx", *[F.col("c.bbox")[k].cast("int").alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))], "c.category", "c.text")


REPLY_CELLS_SQL = f"SELECT doc_id, idx, x0, y0, x1, y1, category, text FROM {INPUT_SQL['boxes']}"


def chat_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.to_json(F.struct(F.array(F.struct(F.struct("text").alias("message"), F.when(F.col("turn") % 2 == 0, "length").otherwise("stop").alias("finish_reason"))).alias("choices")))
    got = J.chat_content(F.replace(made, F.lit('"message":{"text"'), F.lit('"message":{"content"')))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", got["content"].alias("content"), got["truncated"].alias("truncated"))


CHAT_CONTENTS_SQL = "SELECT conv_id, turn, text AS content, turn % 2 = 0 AS truncated FROM conversations"


def degenerate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", J.degenerate(F.col("text")).alias("degenerate"))


def blocks_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.markdown(read(spark, sf_dir, "blocks"))


BLOCKS_MARKDOWN_SQL = f"""
WITH m AS (SELECT doc_id, page, reading_order, coalesce(html, '$$' || chr(10) || latex || chr(10) || '$$', CASE category WHEN 'title' THEN '# ' || text WHEN 'list' THEN '- ' || text ELSE text END, '![](' || asset_path || ')') AS md FROM {INPUT_SQL['blocks']})
SELECT doc_id, string_agg(md, chr(10) || chr(10) ORDER BY page, reading_order) AS markdown FROM m WHERE md IS NOT NULL GROUP BY 1
"""


def content_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.content_list(read(spark, sf_dir, "blocks"))


_FIELD = lambda c: f"CASE WHEN {c} IS NOT NULL THEN ',\"{c}\":\"' || {c} || '\"' ELSE '' END"
CONTENT_LISTS_SQL = f"""
SELECT doc_id, '[' || string_agg('{{"page_num":' || page || {' || '.join(_FIELD(c) for c in ('category', 'text', 'html', 'latex', 'asset_path'))} || '}}', ',' ORDER BY page, reading_order) || ']' AS content FROM {INPUT_SQL['blocks']} GROUP BY 1
"""


def title_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "text_lines").select("doc_id", "line_no", L.is_title_like(F.col("line")).alias("title_like"))


_LINE = _trim("line")
_ITEM = f"(regexp_matches({_LINE}, '^[•\\-*○●◦] ') OR (regexp_matches(left({_LINE}, 5), '^[0-9]{{0,4}}[.)]') AND regexp_matches(left({_LINE}, 5), '[0-9]')) OR regexp_matches({_LINE}, '^(?:[A-Za-z][.)]|\\(.\\))'))"
TITLE_LIKE_SQL = f"""
SELECT doc_id, line_no, len(string_split_regex({_LINE}, '[\\s\\p{{Z}}]+')) BETWEEN 1 AND 12 AND length({_LINE}) BETWEEN 4 AND 140 AND regexp_matches({_LINE}, '\\p{{L}}') AND NOT regexp_matches({_LINE}, '[.,;]$') AND NOT {_ITEM}
  AND NOT regexp_matches({_LINE}, {q(L.CAPTION)}) AND NOT regexp_matches({_LINE}, {q(L.DOT_LEADERS)}) AS title_like FROM {INPUT_SQL['text_lines']}
"""


def financial_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.split_financial(read(spark, sf_dir, "amounts")).select("doc_id", "item_no", "part", "text", F.round("x", 6).alias("x"), F.round("width", 6).alias("width"))


_WORD = "[0-9,.()+%-]*[0-9][0-9,.()+%-]*"
FINANCIAL_ITEMS_SQL = f"""
WITH t AS (SELECT *, trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g')) AS plain FROM {INPUT_SQL['amounts']}),
v AS (SELECT *, CASE WHEN regexp_full_match(plain, '(\\$ {_WORD}|{_WORD}|[—–‒-])( (\\$ {_WORD}|{_WORD}|[—–‒-]))*') THEN regexp_extract_all(plain, '\\$ [^ ]+|[^ ]+') END AS vs FROM t),
s AS (SELECT *, width > font_size * 20 AND NOT regexp_matches(text, '\\p{{L}}{{2}}') AND len(vs) >= 3 AS split FROM v)
SELECT doc_id, item_no, CAST(unnest(range(0, len(vs))) AS INT) AS part, unnest(vs) AS text, round(x + width / len(vs) * (unnest(range(0, len(vs))) + 0.5), 6) AS x, round(width / len(vs) * 0.9, 6) AS width FROM s WHERE split
UNION ALL SELECT doc_id, item_no, 0, text, round(x, 6), round(width, 6) FROM s WHERE NOT coalesce(split, false)
"""


def document_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    docs = read(spark, sf_dir, "orders").select(n.alias("doc_id"), F.when(n % 5 == 0, "scanned").when(n % 5 == 1, "mixed").otherwise("text_based").alias("pdf_type"), (n % 7).alias("pages"), F.least(n % 4, n % 7).alias("with_tables"), F.least(n % 3, n % 7).alias("with_columns"), F.least(F.col("o_custkey") % 3, n % 7).alias("needing_ocr"))
    return E.document_profile(docs).select("doc_id", "mix", "kind", "confidence")


DOCUMENT_PROFILES_SQL = """
WITH d AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 = 0 THEN 'scanned' WHEN o_orderkey % 5 = 1 THEN 'mixed' ELSE 'text_based' END AS pdf_type, o_orderkey % 7 AS pages, least(o_orderkey % 4, o_orderkey % 7) AS t, least(o_orderkey % 3, o_orderkey % 7) AS c, least(o_custkey % 3, o_orderkey % 7) AS o FROM orders),
m AS (SELECT *, CASE WHEN pages = 0 THEN 'mixed' WHEN pdf_type = 'scanned' THEN 'image_dense' WHEN t * 2 > pages THEN 'table_dense' WHEN pdf_type = 'text_based' AND (pages - o) * 10 > pages * 7 THEN 'text_dominant' ELSE 'mixed' END AS mix FROM d)
SELECT doc_id, mix, CASE WHEN pages = 0 THEN 'unknown' WHEN mix = 'text_dominant' THEN 'report' WHEN pages <= 2 AND c > 0 THEN 'resume' ELSE 'unknown' END AS kind,
  CAST(CASE WHEN pages = 0 THEN 0.1 WHEN mix = 'text_dominant' THEN 0.8 WHEN pages <= 2 AND c > 0 THEN 0.6 ELSE 0.3 END AS DOUBLE) AS confidence FROM m
"""


def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = F.array(*[F.col(c).cast("double") for c in ("x1", "y0", "x0", "y1")])
    eight = F.array(*[F.col(c).cast("double") for c in ("x0", "y1", "x1", "y1", "x1", "y0", "x0", "y0")])
    four, whole = G.polygon_bounds(corners), G.polygon_bounds(F.when(F.col("idx") % 3 == 0, F.slice(eight, 1, 6)).otherwise(eight))
    points = G.pixels_to_points(four, F.col("idx") % 4 * 72, F.lit(5.0), F.lit(7.0))
    return read(spark, sf_dir, "boxes").select("doc_id", "idx", four["x0"].alias("x0"), whole["y1"].alias("y1"), F.round(points["x1"], 6).alias("px"), F.round(points["y0"], 6).alias("py"))


CROP_BOXES_SQL = f"""
SELECT doc_id, idx, CAST(x0 AS DOUBLE) AS x0, CASE WHEN idx % 3 > 0 THEN CAST(y1 AS DOUBLE) END AS y1, round(x1 * CASE WHEN idx % 4 > 0 THEN 1.0 / (idx % 4) ELSE 1.0 END + 5, 6) AS px, round(y0 * CASE WHEN idx % 4 > 0 THEN 1.0 / (idx % 4) ELSE 1.0 END + 7, 6) AS py FROM {INPUT_SQL['boxes']}
"""


QUERIES = {
    f.__name__: f
    for f in (
        box_math, boxes_kept, gap_bands, reading_order, paragraphs, region_items, snapped_edges, folio_pairs, base_fonts, font_rarity, text_rows, paragraph_thresholds, heading_levels, delimiters,
        header_rows, cells_repeated, cells_merged, tables_html, tables_markdown, table_checks, continuation_tables, otsl_tables, categories, layout_boxes, reply_cells, chat_contents,
        degenerate_texts, blocks_markdown, content_lists, title_like, merge_warnings, financial_items, document_profiles, crop_boxes,
    )
}
ORACLE_SQL = {name: globals()[f"{name.upper()}_SQL"] for name in QUERIES if f"{name.upper()}_SQL" in globals()}
