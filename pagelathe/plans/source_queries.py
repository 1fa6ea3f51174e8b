"""Registered queries over the readers, with their SQL for DuckDB where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.plans.inputs import INPUT_SQL, read
from pagelathe.sources import files


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return pages.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parsed(_pages(spark, sf_dir)).where("record = 'block'").select("path", "unit_no", "block_no", "type", "level", "text")


def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.markdown(files.parsed(_pages(spark, sf_dir)))


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1))
    return read(spark, sf_dir, "pages").select("page_id", F.size(found).alias("links"), F.array_join(found, " ").alias("targets"))


HTML_LINKS_SQL = """SELECT page_id, CAST(len(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS INT) AS links, array_to_string(regexp_extract_all(html, '<a href="([^"]*)">', 1), ' ') AS targets FROM pages"""


def delimited_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("l")))).alias("r"))
    text = F.concat(F.lit("order,status\n"), F.array_join(F.transform("r", lambda x: x["l"]), "\n"))
    parsed = files.parsed(rows.select(F.concat(F.col("o_custkey").cast("string"), F.lit(".csv")).alias("path"), F.encode(text, "UTF-8").alias("content")))
    return parsed.where("type = 'table'").select("path", F.inline("cells")).select("path", "row", "col", "text", "kind")


DELIMITED_CELLS_SQL = """
WITH o AS (SELECT o_custkey || '.csv' AS path, o_orderkey, o_orderstatus, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS r FROM orders)
SELECT path, r AS "row", 0 AS col, CAST(o_orderkey AS STRING) AS text, 'number' AS kind FROM o UNION ALL SELECT path, r, 1, o_orderstatus, 'text' FROM o
UNION ALL SELECT DISTINCT path, 0, 0, 'order', 'text' FROM o UNION ALL SELECT DISTINCT path, 0, 1, 'status', 'text' FROM o
"""


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = read(spark, sf_dir, "values").select(
        "id",
        F.when(F.col("n") % 5 == 0, F.unhex(F.lit("255044462D312E34"))).when(F.col("n") % 5 == 1, F.unhex(F.lit("504B030414"))).when(F.col("n") % 5 == 2, F.unhex(F.lit("89504E470D0A1A0A00")))
        .when(F.col("n") % 5 == 3, F.encode(F.lit("{\\rtf1"), "UTF-8")).otherwise(F.encode(F.lit("a,b"), "UTF-8")).alias("content"),
        F.when(F.col("n") % 2 == 0, "x.CSV").otherwise("x.bin").alias("path"),
    )
    return made.select("id", files.signature(F.col("content"), F.col("path")).alias("format"), F.octet_length("content").alias("bytes"))


SIGNATURES_SQL = f"""
SELECT id, CASE n % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN 'png' WHEN 3 THEN 'rtf' ELSE CASE WHEN n % 2 = 0 THEN 'csv' ELSE 'unknown' END END AS format,
  CAST(CASE n % 5 WHEN 0 THEN 8 WHEN 1 THEN 5 WHEN 2 THEN 9 WHEN 3 THEN 6 ELSE 3 END AS INT) AS bytes FROM {INPUT_SQL['values']}
"""

QUERIES = {f.__name__: f for f in (html_blocks, html_markdown, html_links, delimited_cells, signatures)}
ORACLE_SQL = {name: globals()[f"{name.upper()}_SQL"] for name in QUERIES if f"{name.upper()}_SQL" in globals()}
