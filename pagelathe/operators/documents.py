"""Operators on tables of documents and of their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.functions import lines as L

# Fixed values.
EDGE_ROWS, LEAST_PAGES, LEAST_KEY_BYTES, PAGE_SHARE, MOST_SPREAD = 5, 3, 10, 0.30, 0.05
SPARSE_PAGE_CHARS, SPARSE_BYTES = 50, 500


def exploded_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line): \\r\\n counts as \\n, a last empty line is none. Null texts have no lines."""
    plain = F.regexp_replace(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), r"\n\z", "")
    return docs.select(key, F.posexplode(F.split(plain, "\n")).alias("line_no", "line"))


def line_profile(docs: DataFrame) -> DataFrame:
    """Counts of kinds of lines of each document, and the route that they ask for. One shuffle, on doc_id."""
    line = F.col("line")
    full = exploded_lines(docs).where(L.utrim(line) != "")
    n = lambda c: F.sum(c.cast("long"))
    counts = full.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"),
        n(L.is_page_number(line)).alias("page_numbers"),
        n(L.is_list_item(line)).alias("list_items"),
        n(L.is_caption(line)).alias("captions"),
        n(L.is_code_like(line)).alias("code_lines"),
        n(L.has_dot_leaders(line)).alias("leader_lines"),
        n(L.is_decorative(line)).alias("decorative_lines"),
        n(line.contains("|")).alias("table_lines"),
    )
    mix = F.when(F.col("table_lines") * 2 > F.col("n_lines"), "table_dense").when(F.col("code_lines") * 10 < F.col("n_lines") * 3, "text_dominant").otherwise("mixed")
    return counts.withColumn("mix", mix).withColumn("route", route(F.lit("unknown"), F.col("mix"), F.lit(False)))


def route(kind: Column, mix: Column, has_chart: Column) -> Column:
    """The protocol for a document's kind and mix of content; the first rule that holds."""
    return (
        F.when(mix == "text_dominant", "native")
        .when(kind == "slide", "mineru-vlm")
        .when((kind == "resume") & (mix == "mixed"), "mineru-vlm")
        .when(mix == "table_dense", "pipeline")
        .when(has_chart, "mineru-vlm")
        .otherwise("mineru-vlm")
    )


def format_profile(fmt: Column) -> Column:
    """(kind, confidence, mix) of a format alone."""
    out = lambda k, c, m: F.struct(F.lit(k).alias("kind"), F.lit(c).alias("confidence"), F.lit(m).alias("mix"))
    return F.when(fmt == "pptx", out("slide", 0.6, "mixed")).when(fmt.isin("xlsx", "csv"), out("spreadsheet", 0.9, "table_dense")).otherwise(out("unknown", 0.1, "mixed"))


def strip_running_lines(lines: DataFrame) -> DataFrame:
    """lines (doc_id, page, line_no, text, y) without repeated headers and footers.

    A line at one of the EDGE_ROWS highest or lowest distinct y of its page counts, compared without digits at its
    ends, if it is long enough, looks like no heading or list, stands on enough pages and at nearly one height. Its
    first page keeps its copy.
    """
    page = Window.partitionBy("doc_id", "page")
    ranked = (
        lines.withColumn("_key", L.compare_key(F.col("text")))
        .withColumn("_up", F.dense_rank().over(page.orderBy("y")))
        .withColumn("_down", F.dense_rank().over(page.orderBy(F.desc("y"))))
        .withColumn("_edge", (F.col("_up") <= EDGE_ROWS) | (F.col("_down") <= EDGE_ROWS))
    )
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("_pages"))
    span = lines.groupBy("doc_id", "page").agg((F.max("y") - F.min("y")).alias("s")).groupBy("doc_id").agg(F.avg("s").alias("_span"))
    found = (
        ranked.where(F.col("_edge") & (F.octet_length("_key") >= LEAST_KEY_BYTES) & ~L.is_structural(F.col("text")))
        .groupBy("doc_id", "_key")
        .agg(F.count_distinct("page").alias("_on"), F.stddev_pop("y").alias("_dev"), F.min("page").alias("_first"))
        .join(pages, "doc_id")
        .join(span, "doc_id")
        .where((F.col("_pages") >= LEAST_PAGES) & (F.col("_on") >= F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("_pages") * PAGE_SHARE))) & (F.col("_dev") < F.col("_span") * MOST_SPREAD))
        .select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "_first")
    )
    gone = (F.col("doc_id") == F.col("_d")) & (F.col("_key") == F.col("_k")) & F.col("_edge") & (F.col("page") > F.col("_first"))
    return ranked.join(found, gone, "left_anti").select(lines.columns)


def drop_page_number_lines(lines: DataFrame) -> DataFrame:
    """lines (doc_id, line_no, line) without page numbers that stand alone: an edge, an empty line or --- on both sides."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    free = lambda c: c.isNull() | (L.utrim(c) == "") | (L.utrim(c) == "---")
    around = lines.withColumn("_before", F.lag("line").over(order)).withColumn("_after", F.lead("line").over(order))
    alone = L.is_page_number(F.col("line")) & (L.utrim(F.col("line")) != "") & ((free(F.col("_before")) & free(F.col("_after"))) | F.coalesce(L.utrim(F.col("_after")) == "---", F.lit(False)))
    return around.where(~alone).select(lines.columns)


def code_blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, block_no, first_line, last_line, n_lines): runs of code-like lines, ended by any other line."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    flagged = lines.withColumn("_code", L.is_code_like(F.col("line"))).withColumn("_new", (F.col("_code") & ~F.coalesce(F.lag("_code").over(order), F.lit(False))).cast("int"))
    runs = flagged.withColumn("block_no", F.sum("_new").over(order)).where("_code")
    return runs.groupBy("doc_id", "block_no").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("n_lines"))


def markdown_text(docs: DataFrame) -> DataFrame:
    """(doc_id, markdown) of plain texts: list items rewritten, code runs fenced, the lines in order."""
    rows = exploded_lines(docs)
    order = Window.partitionBy("doc_id").orderBy("line_no")
    code = L.is_code_like(F.col("line")) & (L.utrim(F.col("line")) != "")
    marked = rows.withColumn("_code", code).withColumn("_was", F.coalesce(F.lag("_code").over(order), F.lit(False))).withColumn("_next", F.coalesce(F.lead("_code").over(order), F.lit(False)))
    body = F.when(F.col("_code"), F.col("line")).when(L.is_list_item(F.col("line")), L.format_list_item(F.col("line"))).otherwise(L.utrim(F.col("line")))
    opened = F.concat(F.when(F.col("_code") & ~F.col("_was"), "```\n").otherwise(""), body, F.when(F.col("_code") & ~F.col("_next"), "\n```").otherwise(""))
    lined = marked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", opened.alias("md")))).alias("l"))
    return lined.select("doc_id", F.array_join(F.transform("l", lambda x: x["md"]), "\n").alias("markdown"))


def needs_ocr(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, chars, bytes, sparse): a document whose text layer is too thin to be the whole text."""
    sums = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"))
    return sums.withColumn("sparse", (F.col("chars") < F.col("pages") * SPARSE_PAGE_CHARS) & (F.col("bytes") < SPARSE_BYTES))
