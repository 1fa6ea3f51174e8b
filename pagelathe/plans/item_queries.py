"""Registered queries over runs of text, drawn rects and lines, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe import transport
from pagelathe.functions import text as X
from pagelathe.operators import columns as C
from pagelathe.operators import items as I
from pagelathe.operators import pdf_markdown as M
from pagelathe.plans.inputs import INPUT_SQL, read
from pagelathe.plans.text_queries import _trim, q

_RUNS = INPUT_SQL["runs"]
_RECTS = INPUT_SQL["rects"]


def letter_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.letter_spacing(read(spark, sf_dir, "runs")).withColumn("threshold", F.round("threshold", 9))


_CJK_AT = lambda c: f"regexp_matches({c}, {q(X.CJK)})"
_SPACING = f"""
sz AS (SELECT *, {_trim('text')} AS t, lag(text) OVER w AS pt, lag(x) OVER w AS px, lag(width) OVER w AS pw, lag(font_size) OVER w AS pf FROM {_RUNS} WINDOW w AS (PARTITION BY doc_id, page ORDER BY item_no)),
sr AS (SELECT *, CASE WHEN pw > 0 AND pf > 0 AND NOT ({_CJK_AT(f"right({_trim('pt')}, 1)")} OR {_CJK_AT('left(t, 1)')}) THEN CASE WHEN px <= x THEN x - (px + pw) ELSE px - (x + width) END / pf END AS ratio FROM sz),
ss AS (SELECT doc_id, page, count(*) AS n, count(*) FILTER (length(t) = 1) AS single, count(*) FILTER (strlen(t) >= 3) AS long, count(*) FILTER (strlen(t) >= 3 AND regexp_matches(t, '^[^ ](?: [^ ])+$')) AS spaced,
  coalesce(list_sort(list(ratio) FILTER (ratio BETWEEN 0 AND 3)), []) AS rs FROM sr GROUP BY 1, 2),
sa AS (SELECT *, CAST(CASE WHEN len(rs) >= 8 AND rs[1] >= 0.4 THEN greatest(0.5::DOUBLE, least(2.0::DOUBLE, rs[len(rs) // 2 + 1] * 1.55::DOUBLE)) ELSE 0.1 END AS DOUBLE) AS ad, long >= 4 AND spaced * 2 >= long AS wide FROM ss),
spacing AS (SELECT doc_id, page, CASE WHEN wide THEN ad WHEN n >= 10 AND single * 2 >= n AND ad > 0.4 THEN ad ELSE 0.1::DOUBLE END AS threshold, wide AS spaced FROM sa)
"""
LETTER_SPACING_SQL = f"WITH {_SPACING} SELECT doc_id, page, round(threshold, 9) AS threshold, spaced FROM spacing"


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "runs")
    return I.unspaced(runs, I.letter_spacing(runs))


def item_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.item_joins(_prepared(spark, sf_dir))


_IS = lambda c, pattern: f"regexp_matches({c}, {q(pattern)})"
_PIECES = f"""
{_SPACING},
pu AS (SELECT r.* REPLACE (CASE WHEN spaced AND {_IS(_trim('text'), '^[^ ](?: [^ ])+$')} THEN replace(text, ' ', '') ELSE text END AS text), threshold FROM {_RUNS} r JOIN spacing USING (doc_id, page)),
pd AS (SELECT *, sum(len(regexp_extract_all(text, {q(X.RTL)}))) OVER l AS rtl, sum(len(regexp_extract_all(regexp_replace(regexp_replace(text, {q(X.RTL)}, '', 'g'), {q(X.CJK)}, '', 'g'), '\\p{{L}}'))) OVER l AS ltr FROM pu WINDOW l AS (PARTITION BY doc_id, page, line_no)),
pp AS (SELECT *, CASE WHEN rtl > 0 AND rtl > ltr THEN -x ELSE x END AS place FROM pd),
pl AS (SELECT *, {_trim('text')} AS t, lag(item_no) OVER w IS NOT NULL AS has, lag(text) OVER w AS pt, {_trim('lag(text) OVER w')} AS ptt, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(width) OVER w AS pw, lag(font_size) OVER w AS ps, lag(font) OVER w AS pf
  FROM pp WINDOW w AS (PARTITION BY doc_id, page, line_no ORDER BY place, item_no)),
pg AS (SELECT *, right(ptt, 1) AS p, left(t, 1) AS c, length(ptt) AS np, length(t) AS nc, CASE WHEN px <= x THEN x - (px + pw) ELSE px - (x + width) END AS gap, x - (px + length(pt) * (ps * 0.45::DOUBLE)) AS guess, ps * 0.45::DOUBLE AS ch FROM pl),
pj AS (SELECT *, CASE
  WHEN ends_with(pt, ' ') OR starts_with(text, ' ') THEN false
  WHEN c IN ('.', ',', ';', '!', '?', ')', ']', '}}', '''') THEN true
  WHEN p = ':' AND {_IS('c', chr(94) + '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}]$')} THEN false
  WHEN pw > 0 THEN CASE
    WHEN gap > ps * 3 OR gap < -ps THEN false
    WHEN NOT ({_CJK_AT('p')} OR {_CJK_AT('c')}) AND gap >= 0 AND gap < ps * 0.01::DOUBLE AND (starts_with(pf, 'C2_') OR starts_with(pf, 'C0_')) THEN len(list_filter(string_split_regex(pt, '\\s+'), lambda w: w <> '')) >= 3
    WHEN (p IN ('0', '1', '2', '3', '4', '5', '6', '7', '8', '9', ',', '.') AND {_IS('c', '^[0-9%.]$')}) OR (p IN ('+', '-') AND {_IS('c', '^[0-9]$')}) THEN gap > -ps AND gap < ps * 0.3::DOUBLE
    WHEN threshold > 0.2 THEN CASE WHEN np = 1 THEN gap < pw * 1.25::DOUBLE WHEN nc = 1 THEN gap < pw / np * 1.25::DOUBLE ELSE gap < ps * threshold END
    WHEN (np = 1) <> (nc = 1) THEN gap < ps * 0.20::DOUBLE
    WHEN np = 1 THEN CASE WHEN {_IS('p', '^[0-9,.%+-]$')} AND {_IS('c', '^[0-9,.%]$')} THEN gap < ps * 0.25::DOUBLE ELSE gap < ps * threshold END
    WHEN np >= 2 AND nc >= 2 AND {_IS('p', '^' + chr(92) + 'p{Ll}$')} AND {_IS('c', '^' + chr(92) + 'p{Ll}$')} THEN gap < ps * 0.18::DOUBLE
    ELSE gap < ps * 0.15::DOUBLE END
  WHEN guess > ch * 6 THEN false
  WHEN {_CJK_AT('p')} OR {_CJK_AT('c')} THEN guess < ch * 0.8::DOUBLE
  WHEN {_IS('p || c', '^(' + chr(92) + 'p{Lu}{2}|' + chr(92) + 'p{Ll}{2})$')} THEN guess < ch * 0.8::DOUBLE
  WHEN {_IS('p || c', '^' + chr(92) + 'p{Ll}' + chr(92) + 'p{Lu}$')} THEN false
  WHEN {_IS('p || c', '^' + chr(92) + 'p{L}{2}$')} THEN guess < ch * 0.3::DOUBLE
  ELSE guess < ch * 0.5::DOUBLE END AS joined FROM pg)
"""
ITEM_JOINS_SQL = f"WITH {_PIECES} SELECT doc_id, page, line_no, item_no, CASE WHEN has THEN joined END AS joined FROM pj"


def line_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.line_texts(_prepared(spark, sf_dir))


LINE_TEXTS_SQL = f"""
WITH {_PIECES},
a AS (SELECT *, t <> '' AS shown, is_bold AND NOT is_underline AS b, is_italic AND NOT is_underline AS i, is_underline AS u,
  NOT (t = '-' OR starts_with(text, '-') OR (abs(y - py) > 1 AND (font_size / ps < 0.85::DOUBLE OR ps / font_size < 0.85::DOUBLE)) OR joined OR starts_with(text, ' ')) AS apart FROM pj),
v AS (SELECT *, last_value(CASE WHEN shown THEN {{'t': t, 'b': b, 'i': i, 'u': u}} END IGNORE NULLS) OVER (PARTITION BY doc_id, page, line_no ORDER BY place, item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM a),
m AS (SELECT *, CASE WHEN has AND apart AND NOT regexp_matches(pt, '[ -]$') THEN ' ' ELSE '' END || text AS plain,
  CASE WHEN coalesce(o.i, false) AND NOT i THEN '*' ELSE '' END || CASE WHEN coalesce(o.b, false) AND NOT b THEN '**' ELSE '' END || CASE WHEN coalesce(o.u, false) AND NOT u THEN '</u>' ELSE '' END
  || CASE WHEN o IS NOT NULL AND ((apart AND NOT ends_with(o.t, '-')) OR starts_with(text, ' ')) THEN ' ' ELSE '' END
  || CASE WHEN u AND NOT coalesce(o.u, false) THEN '<u>' ELSE '' END || CASE WHEN b AND NOT coalesce(o.b, false) THEN '**' ELSE '' END || CASE WHEN i AND NOT coalesce(o.i, false) THEN '*' ELSE '' END || t AS styled FROM v)
SELECT doc_id, page, line_no, string_agg(plain, '' ORDER BY place, item_no) AS text, coalesce(string_agg(styled, '' ORDER BY place, item_no) FILTER (shown), '')
  || coalesce(last(CASE WHEN i THEN '*' ELSE '' END || CASE WHEN b THEN '**' ELSE '' END || CASE WHEN u THEN '</u>' ELSE '' END ORDER BY place, item_no) FILTER (shown), '') AS marked FROM m GROUP BY 1, 2, 3
"""


def grouped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.grouped_lines(read(spark, sf_dir, "runs")).drop("line_y")


GROUPED_LINES_SQL = f"""
WITH RECURSIVE c AS (SELECT *, {_trim('text')} AS t, y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY item_no) AS step FROM {_RUNS}),
f AS (SELECT doc_id, page, count(*) >= 5 AND count(*) FILTER (abs(step) > 50) >= 3 AND count(*) FILTER (step > 50) > count(*) FILTER (abs(step) > 50) * 0.4::DOUBLE AS by_y FROM c GROUP BY 1, 2),
o AS (SELECT c.doc_id, c.page, item_no, x, y, width, font_size, is_bold, len(list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '')) AS words, len(regexp_extract_all(t, '\\p{{L}}')) AS letters, regexp_matches(t, '^\\p{{L}}') AS wordy, regexp_matches(t, '^\\p{{Ll}}') AS low,
  row_number() OVER (PARTITION BY c.doc_id, c.page ORDER BY CASE WHEN by_y THEN -y ELSE 0 END, CASE WHEN by_y THEN x ELSE 0 END, item_no) AS k FROM c JOIN f USING (doc_id, page)),
g AS (
  SELECT doc_id, page, k, item_no, 0 AS line_no, y, x AS first_x, x AS last_x, x + width AS edge, font_size AS size, is_bold AS bold, words, letters FROM o WHERE k = 1
  UNION ALL
  SELECT o.doc_id, o.page, o.k, o.item_no, CASE WHEN n THEN g.line_no + 1 ELSE g.line_no END, CASE WHEN n THEN o.y ELSE g.y END, CASE WHEN n THEN o.x ELSE g.first_x END, o.x, o.x + o.width, o.font_size,
    CASE WHEN n THEN o.is_bold ELSE g.bold AND o.is_bold END, CASE WHEN n THEN o.words ELSE g.words + o.words END, CASE WHEN n THEN o.letters ELSE g.letters + o.letters END
  FROM g JOIN o ON o.doc_id = g.doc_id AND o.page = g.page AND o.k = g.k + 1,
  LATERAL (SELECT abs(g.y - o.y) >= 3 OR (abs(g.y - o.y) > 0.5 AND (abs(o.x - g.first_x) < 5 OR o.x < g.last_x - 10))
    OR (o.x - g.edge > greatest(greatest(o.font_size, g.size) * 3, 30) AND o.wordy AND g.words >= 2 AND g.letters >= 8 AND o.words >= 3 AND o.letters >= 10 AND (o.low OR (g.bold AND NOT o.is_bold))) AS n) z)
SELECT doc_id, page, item_no, CAST(line_no AS INT) AS line_no FROM g
"""


def turned_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, rects = I.turned(read(spark, sf_dir, "runs"), read(spark, sf_dir, "rects"))
    own = items.select(F.lit("item").alias("kind"), "doc_id", "page", F.col("item_no").alias("no"), "x", "y", "width", "height")
    return own.union(rects.select(F.lit("rect"), "doc_id", "page", "rect_no", "x", "y", "width", "height"))


TURNED_ITEMS_SQL = f"""
WITH v AS (SELECT doc_id, page, count(*) >= 2 AND count(*) FILTER (rotated) * 3 >= count(*) * 2 AS turn FROM {_RUNS} GROUP BY 1, 2)
SELECT 'item' AS kind, doc_id, page, item_no AS no, CASE WHEN turn THEN y ELSE x END AS x, CASE WHEN turn THEN -x ELSE y END AS y, CASE WHEN turn AND width < 0.5 THEN length(text) * font_size * 0.5::DOUBLE ELSE width END AS width, height FROM {_RUNS} JOIN v USING (doc_id, page)
UNION ALL SELECT 'rect', doc_id, page, rect_no, CASE WHEN turn THEN y ELSE x END, CASE WHEN turn THEN -(x + abs(width)) ELSE y END, CASE WHEN turn THEN height ELSE width END, CASE WHEN turn THEN width ELSE height END FROM {_RECTS} LEFT JOIN v USING (doc_id, page)
"""


def distinct_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = read(spark, sf_dir, "rects").withColumn("x", F.floor(F.col("x") / 100) * 30 + F.col("rect_no") % 3 / 5).withColumn("y", F.floor(F.col("y") / 200) * 50.0).withColumn("width", F.lit(40.0)).withColumn("height", F.lit(10.25))
    return I.distinct_rects(coarse)


DISTINCT_RECTS_SQL = f"""
WITH c AS (SELECT doc_id, page, rect_no, floor(x / 100) * 30 + (rect_no % 3) / 5 AS x, floor(y / 200) * 50.0::DOUBLE AS y FROM {_RECTS})
SELECT doc_id, page, min(rect_no) AS rect_no, first(x ORDER BY rect_no) AS x, first(y ORDER BY rect_no) AS y, 40.0::DOUBLE AS width, 10.25::DOUBLE AS height FROM c GROUP BY doc_id, page, floor(x * 2), floor(y * 2)
"""


def band_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rects, lines = read(spark, sf_dir, "rects"), read(spark, sf_dir, "drawn_lines")
    bands = rects.select("doc_id", "page").distinct().select("doc_id", "page", F.inline(F.array(*[F.struct(F.lit(k).alias("band"), F.lit(a).alias("x_lo"), F.lit(b).alias("x_hi")) for k, a, b in ((0, 0.0, 60.0), (1, 150.0, 190.0))])))
    return I.rects_in_bands(rects, bands).withColumn("kind", F.lit("rect")).withColumnRenamed("rect_no", "no").union(I.lines_in_bands(lines, bands).withColumn("kind", F.lit("line")))


BAND_CONTENTS_SQL = f"""
WITH b AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 60.0::DOUBLE), (1, 150.0::DOUBLE, 190.0::DOUBLE)) v(band, lo, hi)),
r AS (SELECT doc_id, page, rect_no, least(x, x + width) AS a, greatest(x, x + width) AS z FROM {_RECTS})
SELECT doc_id, page, band, rect_no AS no, 'rect' AS kind FROM r, b WHERE least(z, hi) - greatest(a, lo) > 0 AND (z - a < (hi - lo) * 0.7::DOUBLE OR least(z, hi) - greatest(a, lo) >= (z - a) * 0.7::DOUBLE)
UNION ALL SELECT doc_id, page, band, line_no, 'line' FROM {INPUT_SQL['drawn_lines']}, b WHERE greatest(x1, x2) > lo AND least(x1, x2) < hi
"""


def horizontal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.horizontal_rules(read(spark, sf_dir, "rects"), read(spark, sf_dir, "drawn_lines"))


HORIZONTAL_RULES_SQL = f"""
SELECT doc_id, page, least(x1, x2) AS x1, greatest(x1, x2) AS x2, (y1 + y2) / 2 AS y FROM {INPUT_SQL['drawn_lines']} WHERE stroke_width <= 2 AND abs(y1 - y2) <= 2 AND abs(x2 - x1) > 1
UNION ALL SELECT doc_id, page, least(x, x + width), greatest(x, x + width), y + height / 2 FROM {_RECTS} WHERE abs(height) <= 2 AND abs(width) > 1
"""


def rect_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.rect_clusters(read(spark, sf_dir, "rects").withColumn("width", F.abs("width")), 3.0, 2)


RECT_CLUSTERS_SQL = f"""
WITH RECURSIVE r AS (SELECT doc_id, page, rect_no, x - 3 AS l, x + abs(width) + 3 AS g, y - 3 AS b, y + height + 3 AS t FROM {_RECTS}),
e AS (SELECT a.doc_id, a.page, a.rect_no AS u, c.rect_no AS v FROM r a JOIN r c ON a.doc_id = c.doc_id AND a.page = c.page AND a.rect_no <> c.rect_no AND NOT (a.g < c.l OR c.g < a.l OR a.t < c.b OR c.t < a.b)),
w AS (SELECT doc_id, page, rect_no AS node, rect_no AS seen FROM r UNION SELECT w.doc_id, w.page, w.node, e.v FROM w JOIN e ON e.doc_id = w.doc_id AND e.page = w.page AND e.u = w.seen)
SELECT doc_id, page, node AS rect_no, min(seen) AS cluster FROM w GROUP BY 1, 2, 3 HAVING count(*) >= 2
"""


def line_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.line_styles(read(spark, sf_dir, "runs"))


_STYLES = f"""
si AS (SELECT *, length({_trim('text')}) AS n FROM {_RUNS}),
sf AS (SELECT doc_id, page, line_no, font, sum(greatest(n, 1)) AS w FROM si GROUP BY ALL),
sl AS (SELECT doc_id, page, line_no, sum(n) AS n, coalesce(sum(n) FILTER (is_bold), 0) AS b, first(x ORDER BY x, item_no) AS x FROM si GROUP BY ALL),
st AS (SELECT doc_id, page, line_no, first(font ORDER BY w DESC, font) AS font FROM sf GROUP BY ALL),
styles AS (SELECT doc_id, page, line_no, n > 0 AND b * 2 >= n AS mostly_bold, font, CAST(round(x / 24) AS INT) AS x_bucket, n FROM sl JOIN st USING (doc_id, page, line_no))
"""
LINE_STYLES_SQL = f"WITH {_STYLES} SELECT doc_id, page, line_no, mostly_bold, font, x_bucket FROM styles"


def body_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.body_style(read(spark, sf_dir, "runs"))


BODY_STYLES_SQL = f"""
WITH {_STYLES}, f AS (SELECT doc_id, font, sum(n) AS w FROM si WHERE NOT is_bold GROUP BY ALL), e AS (SELECT doc_id, x_bucket, sum(n) AS w FROM styles WHERE NOT mostly_bold GROUP BY ALL)
SELECT doc_id, body_font, body_bucket FROM (SELECT DISTINCT doc_id FROM si) LEFT JOIN (SELECT doc_id, first(font ORDER BY w DESC, font) AS body_font FROM f GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, first(x_bucket ORDER BY w DESC, x_bucket) AS body_bucket FROM e GROUP BY 1) USING (doc_id)
"""


def cluster_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cluster_counts(read(spark, sf_dir, "runs")).withColumn("column_sizes", F.array_join(F.col("column_sizes").cast("array<string>"), ","))


CLUSTER_COUNTS_SQL = f"""
WITH l AS (SELECT doc_id, page, list_sort(list(y)) AS ys, list_sort(list(x) FILTER ({_trim('text')} <> '')) AS xs FROM {_RUNS} GROUP BY 1, 2),
r AS (SELECT doc_id, page, list_reduce(list_transform(ys, lambda v: {{'c': v, 'n': 1, 'k': 1}}), lambda a, b: CASE WHEN abs(b.c - a.c) > 3 THEN {{'c': b.c, 'n': 1, 'k': a.k + 1}} ELSE {{'c': (a.c * a.n + b.c) / (a.n + 1), 'n': a.n + 1, 'k': a.k}} END).k AS rows,
  list_reduce(list_transform(xs, lambda v: {{'c': v, 'n': 1, 's': ''}}), lambda a, b: CASE WHEN abs(b.c - a.c) > 8 THEN {{'c': b.c, 'n': 1, 's': a.s || a.n || ','}} ELSE {{'c': (a.c * a.n + b.c) / (a.n + 1), 'n': a.n + 1, 's': a.s}} END) AS z FROM l)
SELECT doc_id, page, CAST(rows AS INT) AS rows, coalesce(z.s || z.n, '') AS column_sizes FROM r
"""


def grid_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "runs")
    columns = F.array(*[F.lit(float(v)) for v in (0, 62, 118, 190)])
    return runs.join(I.row_boundaries(runs), ["doc_id", "page"]).select("doc_id", "page", "item_no", F.size("row_ys").alias("rows"), I.row_index(F.col("row_ys"), F.col("y") - 3).alias("row"), I.column_index(columns, F.col("x") * 1.3).alias("col"))


_PLACE = "(CASE WHEN {far} < {most} THEN {k} - 1 END)"
GRID_PLACES_SQL = f"""
WITH l AS (SELECT doc_id, page, list_sort(list(y), 'DESC') AS ys, greatest(list_sort(list(font_size))[count(*) // 2 + 1] * 0.8::DOUBLE, 4) AS far FROM {_RUNS} GROUP BY 1, 2),
b AS (SELECT doc_id, page, list_reduce(list_transform(ys, lambda v: {{'s': v, 'n': 1, 'd': CAST([] AS DOUBLE[])}}), lambda a, e: CASE WHEN a.s / a.n - e.s >= far THEN {{'s': e.s, 'n': 1, 'd': list_append(a.d, a.s / a.n)}} ELSE {{'s': a.s + e.s, 'n': a.n + 1, 'd': a.d}} END) AS z FROM l),
r AS (SELECT doc_id, page, list_append(z.d, z.s / z.n) AS rows FROM b),
p AS (SELECT u.*, rows, [0, 62, 118, 190]::DOUBLE[] AS cols FROM {_RUNS} u JOIN r USING (doc_id, page)),
m AS (SELECT *, list_sort(list_transform(range(1, len(rows) + 1), lambda k: {{'f': abs(y - 3 - rows[k]), 'k': k}}))[1] AS a, list_sort(list_transform(range(1, 5), lambda k: {{'f': abs(x * 1.3::DOUBLE - cols[k]), 'k': k}}))[1] AS c FROM p)
SELECT doc_id, page, item_no, CAST(len(rows) AS INT) AS rows, CAST(CASE WHEN a.f < 15 THEN a.k - 1 END AS INT) AS "row", CAST(CASE WHEN c.f < 28 THEN c.k - 1 END AS INT) AS col FROM m
"""


def line_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "runs").withColumn("page", (F.col("page") + F.col("doc_id") % 4 * 2).cast("int")).withColumn("doc_id", F.floor(F.col("doc_id") / 4))
    names = F.array(*map(F.lit, ("Span", "P", "H1", "H2", "Table", "L", "H", "Div", "P", "P", "P", "P")))
    roles = runs.where("mcid IS NOT NULL").select("doc_id", "page", "mcid").distinct().withColumn("role", F.get(names, ((F.col("mcid") + F.col("doc_id") * F.col("page")) % 12).cast("int")))
    return I.line_roles(runs, roles)


LINE_ROLES_SQL = f"""
WITH u AS (SELECT r.* REPLACE (CAST(page + doc_id % 4 * 2 AS INT) AS page, CAST(floor(doc_id / 4) AS BIGINT) AS doc_id) FROM {_RUNS} r),
r AS (SELECT *, ['Span', 'P', 'H1', 'H2', 'Table', 'L', 'H', 'Div', 'P', 'P', 'P', 'P'][(mcid + doc_id * page) % 12 + 1] AS role FROM u WHERE mcid IS NOT NULL),
l AS (SELECT doc_id, page, line_no, first(role ORDER BY x, item_no) AS role FROM r WHERE role NOT IN ('Span', 'Div') GROUP BY 1, 2, 3),
v AS (SELECT *, CASE WHEN role = 'H' THEN 1 WHEN regexp_matches(role, '^H[1-6]$') THEN CAST(role[2] AS INT) END AS level FROM l),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS a, count(*) OVER (PARTITION BY doc_id, level) AS c FROM v)
SELECT doc_id, page, line_no, role, CASE WHEN NOT (a >= 20 AND c / a > 0.15::DOUBLE) THEN level END AS level FROM n
"""


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cells = read(spark, sf_dir, "cells").select(F.floor(F.col("doc_id") / 6).alias("doc_id"), F.col("doc_id").alias("table_no"), "row", "col", "text")
    claims = read(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 72).alias("doc_id"), F.floor(F.col("o_orderkey") / 12).alias("table_no"), (F.col("o_custkey") % 60).alias("item_no")).where("item_no % 3 > 0").distinct()
    return cells, claims


def table_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, claims = _tables(spark, sf_dir)
    scores = I.table_scores(cells, claims)
    kept = I.selected_tables(scores, claims).withColumn("kept", F.lit(True))
    return scores.join(kept, ["doc_id", "table_no"], "left").select("doc_id", "table_no", "score", "n_items", F.coalesce("kept", F.lit(False)).alias("kept"))


TABLE_CHOICE_SQL = f"""
WITH RECURSIVE c AS (SELECT CAST(floor(doc_id / 6) AS BIGINT) AS doc_id, doc_id AS table_no, "row", col, text FROM {INPUT_SQL['cells']}),
i AS (SELECT DISTINCT CAST(floor(o_orderkey / 72) AS BIGINT) AS doc_id, CAST(floor(o_orderkey / 12) AS BIGINT) AS table_no, o_custkey % 60 AS item_no FROM orders WHERE o_custkey % 60 % 3 > 0),
g AS (SELECT doc_id, table_no, list(item_no) AS items FROM i GROUP BY 1, 2),
s AS (SELECT doc_id, table_no, count(*) AS n, count(*) FILTER (text <> '') AS f, count(DISTINCT "row") FILTER (text <> '') AS r, count(DISTINCT col) FILTER (text <> '') AS k FROM c GROUP BY 1, 2),
p AS (SELECT s.doc_id, s.table_no, coalesce(items, []) AS items, coalesce(len(items), 0) AS n_items, greatest(coalesce(len(items), 0) * 100 + f * 25 + k * 60 + r * 20 - (n - f) * 4, 0) AS score FROM s LEFT JOIN g USING (doc_id, table_no)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, n_items DESC, table_no) AS z FROM p),
w AS (SELECT doc_id, z, table_no, items AS claimed, true AS kept FROM o WHERE z = 1
  UNION ALL SELECT o.doc_id, o.z, o.table_no, CASE WHEN list_has_any(w.claimed, o.items) THEN w.claimed ELSE list_concat(w.claimed, o.items) END, NOT list_has_any(w.claimed, o.items) FROM w JOIN o ON o.doc_id = w.doc_id AND o.z = w.z + 1)
SELECT doc_id, table_no, score, n_items, kept FROM o JOIN w USING (doc_id, table_no)
"""


def folio_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("item_no") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit(" "), (F.col("item_no") % 20000).cast("string")))
    return I.folio_candidates(read(spark, sf_dir, "runs").withColumn("text", shown).withColumn("y", F.col("item_no") % 80 * 10.0))


FOLIO_CANDIDATES_SQL = f"""
WITH r AS (SELECT doc_id, page, item_no, CASE WHEN item_no % 3 = 0 THEN {_trim('text')} ELSE CAST(item_no % 20000 AS STRING) END AS t, item_no % 80 * 10 AS y FROM {_RUNS})
SELECT doc_id, page, item_no, CAST(t AS INT) AS value FROM r WHERE regexp_matches(t, '^[0-9]{{1,4}}$') AND (y > 720 OR y < 100)
"""


def column_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.column_histogram(read(spark, sf_dir, "runs"), 10.0)


COLUMN_HISTOGRAM_SQL = f"""
WITH e AS (SELECT *, CASE WHEN width > 0 THEN width ELSE length(text) * font_size * 0.5::DOUBLE END AS w FROM {_RUNS} WHERE {_trim('text')} <> ''),
s AS (SELECT *, min(x) OVER p AS l, max(x + w) OVER p - min(x) OVER p AS wide FROM e WINDOW p AS (PARTITION BY doc_id, page)),
b AS (SELECT doc_id, page, unnest(range(CAST(floor((x - l) / 10) AS INT), CAST(ceil((x + w - l) / 10) AS INT))) AS bin FROM s WHERE w <= wide * 0.6::DOUBLE AND w > 0)
SELECT doc_id, page, CAST(bin AS INT) AS bin, count(*) AS n FROM b GROUP BY 1, 2, 3
"""


def retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    status = F.get(F.array(*map(F.lit, (200, 200, 429, 500, 503, 404, 0))), (n % 7).cast("int"))
    calls = read(spark, sf_dir, "orders").select(n.alias("call_id"), F.nullif(status, F.lit(0)).alias("status"), (F.col("o_custkey") % 2 == 0).alias("valid"), (n % 11 + 1).cast("int").alias("attempt"), F.lit(8).alias("max_retries"), F.when(n % 4 == 0, n % 50).alias("retry_after"))
    return transport.with_decision(calls)


RETRY_PLAN_SQL = """
WITH c AS (SELECT o_orderkey AS call_id, nullif([200, 200, 429, 500, 503, 404, 0][o_orderkey % 7 + 1], 0) AS status, o_custkey % 2 = 0 AS valid, CAST(o_orderkey % 11 + 1 AS INT) AS attempt, 8 AS max_retries, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 50 END AS retry_after FROM orders),
a AS (SELECT *, CASE WHEN status = 200 AND valid THEN 'done' WHEN (status IS NULL OR status >= 500 OR status = 429 OR status = 200) AND attempt <= max_retries THEN 'retry' ELSE 'failed' END AS action FROM c)
SELECT *, CAST(CASE WHEN action = 'retry' THEN CASE WHEN retry_after IS NOT NULL AND (status = 429 OR status >= 500) THEN least(retry_after, 30) * 1000 ELSE least(50 * pow(2, least(attempt - 1, 20)), 5000) END END AS BIGINT) AS most_delay_ms FROM a
"""

def reading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.reading_lines(read(spark, sf_dir, "two_columns")).select("doc_id", "page", "item_no", "line_no")


#: The made pages have a title over two columns. Those of many lines are read column by column, those of few and wide
#: apart row by row.
READING_LINES_SQL = f"""
WITH i AS (SELECT *, place % 2 = 1 AS is_left, CAST(floor((place - 1) / 2) AS INT) AS row_no, count(*) FILTER (place > 0 AND place % 2 = 1) OVER (PARTITION BY doc_id) AS lefts, count(*) OVER (PARTITION BY doc_id) AS n FROM {INPUT_SQL['two_columns']} WHERE text <> '')
SELECT doc_id, page, item_no, CAST(CASE WHEN place = 0 THEN 0 WHEN NOT news THEN row_no + 1 WHEN is_left THEN row_no + 1 ELSE lefts + row_no + 1 END AS INT) AS line_no FROM i
"""


def paper_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.markdown_of_items(read(spark, sf_dir, "two_columns").where("news AND place < 80"))


#: Of the same pages: the title as a heading, each column as a paragraph; the second begins where the height jumps back.
PAPER_MARKDOWN_SQL = f"""
WITH i AS (SELECT * FROM {INPUT_SQL['two_columns']} WHERE news AND place < 80)
SELECT doc_id, '# ' || first(text) FILTER (place = 0) || chr(10) || chr(10) || string_agg(text, ' ' ORDER BY place) FILTER (place % 2 = 1) || chr(10) || chr(10) || string_agg(text, ' ' ORDER BY place) FILTER (place > 0 AND place % 2 = 0) || chr(10) AS markdown FROM i GROUP BY 1
"""

QUERIES = {
    f.__name__: f
    for f in (
        letter_spacing, item_joins, line_texts, grouped_lines, turned_items, distinct_rects, band_contents, horizontal_rules, rect_clusters, line_styles, body_styles, cluster_counts, grid_places, line_roles,
        table_choice, folio_candidates, column_histogram, retry_plan, reading_lines, paper_markdown,
    )
}
ORACLE_SQL = {name: globals()[f"{name.upper()}_SQL"] for name in QUERIES if f"{name.upper()}_SQL" in globals()}
