"""What pages and their parts show: marks on items, grids, samples, profiles, headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.functions import lines as L
from pagelathe.functions import quality as Q
from pagelathe.operators.ranges import BAND, banded

# Fixed values.
RULE_THICKNESS, RULE_OVERLAP, RULE_BELOW = 2.0, 0.6, 3.0
FACTOR, LEAST_PIXELS, MOST_PIXELS = 28, 3136, 11_289_600
UNITS = "°|V|A|Hz|µ|pin"
TABLE_SHARE, TEXT_SHARE = 0.5, 0.7


def underlined(items: DataFrame, rules: DataFrame) -> DataFrame:
    """The items (doc_id, page, item_no, ...) under which a thin rule runs along most of their width."""
    top = F.col("y") + F.col("height")
    # an item is in the one band of its baseline; a rule in all bands whose baselines it may underline
    i = items.withColumn("_band", F.floor(F.col("y") / BAND).cast("int")).alias("i")
    r = banded(rules.where(F.col("height") <= RULE_THICKNESS), top - 1, top + RULE_BELOW).alias("r")
    along = F.least(F.col("i.x") + F.col("i.width"), F.col("r.x") + F.col("r.width")) - F.greatest("i.x", "r.x")
    below = (F.col("r.y") + F.col("r.height")).between(F.col("i.y") - RULE_BELOW, F.col("i.y") + 1)
    same = (F.col("i.doc_id") == F.col("r.doc_id")) & (F.col("i.page") == F.col("r.page")) & (F.col("i._band") == F.col("r._band"))
    return i.join(r, same & below & (along >= F.col("i.width") * RULE_OVERLAP), "left_semi").select(items.columns)


def outside(items: DataFrame, regions: DataFrame) -> DataFrame:
    """The items whose centre lies in no region (doc_id, page, x0, y0, x1, y1) of their page."""
    i = items.withColumn("_band", F.floor((F.col("y") + F.col("height") / 2) / BAND).cast("int")).alias("i")
    r = banded(regions, F.col("y0"), F.col("y1")).alias("r")
    cx, cy = F.col("i.x") + F.col("i.width") / 2, F.col("i.y") + F.col("i.height") / 2
    same = (F.col("i.doc_id") == F.col("r.doc_id")) & (F.col("i.page") == F.col("r.page")) & (F.col("i._band") == F.col("r._band"))
    return i.join(r, same & cx.between(F.col("r.x0"), F.col("r.x1")) & cy.between(F.col("r.y0"), F.col("r.y1")), "left_anti").select(items.columns)


def in_grid(items: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """(doc_id, row, col, n, text) of items by the bands (doc_id, band, low, high) that hold their centre."""
    i, r, c = items.alias("i"), rows.alias("r"), cols.alias("c")
    cx, cy = F.col("i.x") + F.col("i.width") / 2, F.col("i.y") + F.col("i.height") / 2
    by_row = i.join(r, (F.col("i.doc_id") == F.col("r.doc_id")) & (cy >= F.col("r.low")) & (cy < F.col("r.high")))
    placed = by_row.join(c, (F.col("i.doc_id") == F.col("c.doc_id")) & (cx >= F.col("c.low")) & (cx < F.col("c.high")))
    got = placed.groupBy(F.col("i.doc_id").alias("doc_id"), F.col("r.band").alias("row"), F.col("c.band").alias("col"))
    out = got.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("i.page", "i.x", "i.item_no", "i.text"))).alias("t"))
    return out.select("doc_id", "row", "col", "n", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))


def nearest_anchor(items: DataFrame, anchors: DataFrame, most: float) -> DataFrame:
    """(doc_id, item_no, anchor): the column anchor (doc_id, anchor, x) nearest to an item's left edge, within most."""
    i, a = items.alias("i"), anchors.alias("a")
    far = F.abs(F.col("i.x") - F.col("a.x"))
    near = i.join(a, (F.col("i.doc_id") == F.col("a.doc_id")) & (far <= most))
    return near.groupBy(F.col("i.doc_id").alias("doc_id"), F.col("i.item_no").alias("item_no")).agg(F.min_by("a.anchor", F.struct(far.alias("far"), "a.anchor")).alias("anchor"))


def sampled_pages(total: Column, n: int) -> Column:
    """Up to n pages, in order: the first, the last and, at whole steps from the first, those between."""
    step = F.floor((total - 2) / (n - 1))
    between = F.transform(F.sequence(F.lit(1), F.lit(n - 2)), lambda k: (k * step + 1).cast("int"))
    some = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(1), total.cast("int")), between)))
    return F.when(total <= n, F.sequence(F.lit(1), total)).otherwise(some)


def resized(width: Column, height: Column) -> Column:
    """(width, height) as multiples of FACTOR with LEAST_PIXELS to MOST_PIXELS, the shape kept as well as may be."""
    near = lambda v: F.greatest(F.lit(FACTOR), F.round(v / FACTOR) * FACTOR)
    w, h = near(width), near(height)
    down, up = F.sqrt(width * height / F.lit(float(MOST_PIXELS))), F.sqrt(F.lit(float(LEAST_PIXELS)) / (width * height))
    fit = lambda v, plain: F.when(w * h > MOST_PIXELS, F.floor(v / down / FACTOR) * FACTOR).when(w * h < LEAST_PIXELS, F.ceil(v * up / FACTOR) * FACTOR).otherwise(plain)
    return F.struct(fit(width, w).cast("int").alias("width"), fit(height, h).cast("int").alias("height"))


def rescaled(b: Column, ratio_x: Column, ratio_y: Column) -> Column:
    """A box of a resized page on the original; null where a ratio is 0."""
    part = lambda c: F.round(b[c] / F.nullif(ratio_x if c[0] == "x" else ratio_y, F.lit(0))).cast("int").alias(c)
    return F.struct(*[part(c) for c in ("x0", "y0", "x1", "y1")])


def is_data_like(text: Column) -> Column:
    """What table cells hold: numbers, dates, short codes, amounts with units, numbers in parentheses."""
    t = L.utrim(text)
    digits = F.regexp_count(t, F.lit("[0-9]"))
    date = (F.octet_length(t) <= 10) & (digits >= 4) & t.rlike("[/-]") & t.rlike(r"^[0-9/.\-]+$")
    code = (F.octet_length(t) <= 10) & t.rlike(r"^[\p{L}\p{N}]+$") & (digits > 0)
    return (t != "") & (L.is_number(t) | date | code | ((digits > 0) & t.rlike(UNITS)) | t.rlike(r"^\([0-9.,+-]+\)$"))


def layout_complexity(pages: DataFrame) -> DataFrame:
    """(doc_id, pages_with_tables, pages_with_columns, is_complex) of pages (doc_id, page, tables, columns)."""
    on = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("page"))))
    got = pages.groupBy("doc_id").agg(on(F.col("tables") > 0).alias("pages_with_tables"), on(F.col("columns") > 1).alias("pages_with_columns"))
    return got.withColumn("is_complex", (F.size("pages_with_tables") > 0) | (F.size("pages_with_columns") > 0))


def content_mix(pages: DataFrame) -> DataFrame:
    """(doc_id, table_share, text_share, mix): whether tables or plain text fill most pages."""
    share = lambda c: F.sum(c.cast("long")) / F.count("*")
    plain = (F.col("tables") == 0) & (F.col("text_chars") > 0)
    got = pages.groupBy("doc_id").agg(share(F.col("tables") > 0).alias("table_share"), share(plain).alias("text_share"))
    return got.withColumn("mix", F.when(F.col("table_share") > TABLE_SHARE, "table_dense").when(F.col("text_share") > TEXT_SHARE, "text_dominant").otherwise("mixed"))


def ocr_reasons(pages: DataFrame) -> DataFrame:
    """(doc_id, page, reasons) of pages that need recognition: garbled, vector_text, no_text or scanned."""
    when = lambda c, name: F.when(c, F.lit(name))
    thin = F.col("text_chars") == 0
    found = F.array_compact(F.array(when(F.col("garbled"), "garbled"), when(F.col("vector_text"), "vector_text"), when(thin & (F.col("images") == 0), "no_text"), when(thin & (F.col("images") > 0), "scanned")))
    return pages.select("doc_id", "page", found.alias("reasons")).where(F.size("reasons") > 0)


def page_rotation(items: DataFrame) -> DataFrame:
    """(doc_id, page, rotation): that of most items, of equally many the smaller."""
    votes = items.groupBy("doc_id", "page", "rotation").count()
    return votes.groupBy("doc_id", "page").agg(F.max_by("rotation", F.struct("count", -F.col("rotation"))).alias("rotation"))


def contents_runs(entries: DataFrame) -> DataFrame:
    """(doc_id, run, first_line, entries): runs of contents entries (doc_id, line_no, page_number) that never go back."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    new = F.coalesce((F.col("page_number") < F.lag("page_number").over(order)).cast("int"), F.lit(0))
    runs = entries.withColumn("_new", new).withColumn("run", F.sum("_new").over(order))
    return runs.groupBy("doc_id", "run").agg(F.min("line_no").alias("first_line"), F.count("*").alias("entries"))


def merged_headings(lines: DataFrame) -> DataFrame:
    """(doc_id, first_line, level, text): consecutive lines (doc_id, line_no, level, text) of one heading level joined."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    same = F.col("level").isNotNull() & (F.col("level") == F.lag("level").over(order)) & (F.col("line_no") == F.lag("line_no").over(order) + 1)
    runs = lines.withColumn("_new", F.coalesce((~same).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(order)).where("level IS NOT NULL")
    got = runs.groupBy("doc_id", "_run").agg(F.min("line_no").alias("first_line"), F.first("level").alias("level"), F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("t"))
    return got.select("doc_id", "first_line", "level", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))


def isolated_lines(lines: DataFrame, gap: float) -> DataFrame:
    """The lines (doc_id, page, line_no, y, ...) with more than gap to both neighbours on their page, or none on a side."""
    order = Window.partitionBy("doc_id", "page").orderBy("line_no")
    free = lambda d: F.coalesce(d > gap, F.lit(True))
    got = lines.withColumn("_up", F.lag("y").over(order) - F.col("y")).withColumn("_down", F.col("y") - F.lead("y").over(order))
    return got.where(free(F.col("_up")) & free(F.col("_down"))).select(lines.columns)


def page_text_quality(items: DataFrame) -> DataFrame:
    """(doc_id, page, chars, replacements, spans, longest, strong, garbled, needs_ocr) of items (doc_id, page, text).

    strong: some run of text is broken beyond doubt. Replacement characters count in runs that hold enough of them;
    whether they are many is judged for the page, and so are its letters.
    """
    one = items.select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text")).withColumn("e", Q.cipher_evidence(F.col("text"))).withColumn("issue", Q.span_issue(F.col("text"))).withColumn("r", Q.replacement_runs(F.col("text")))
    bad = F.col("issue") == "replacement"
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    got = one.groupBy("doc_id", "page").agg(
        F.sum(Q.count(F.col("text"), Q.VISIBLE)).alias("chars"), total(F.when(bad, F.col("r.replacements"))).alias("replacements"), total(bad.cast("int")).alias("spans"),
        F.coalesce(F.max(F.when(bad, F.col("r.longest"))), F.lit(0)).alias("longest"), F.coalesce(F.bool_or(F.col("issue") == "strong"), F.lit(False)).alias("strong"),
        F.array(*[F.sum(F.col("e.counts")[k]) for k in range(26)]).alias("counts"), *[F.sum(f"e.{c}").alias(c) for c in ("letters", "vowels", "more_latin", "other", "pairs", "shifts")],
    )
    evidence = F.struct("counts", "letters", "vowels", "more_latin", "other", "pairs", "shifts")
    density = F.floor(F.col("replacements") * 10_000 / F.col("chars"))
    dense = ((F.col("replacements") >= 12) & (density >= 500)) | ((F.col("spans") >= 3) & (density >= 250)) | ((F.col("longest") >= 8) & (density >= 250))
    broken = (F.col("replacements") > 0) & (F.col("chars") > 0) & (((F.col("chars") <= 80) & (F.col("longest") >= 2)) | dense)
    judged = got.withColumn("garbled", Q.looks_garbled(evidence)).withColumn("needs_ocr", F.col("strong") | F.coalesce(broken, F.lit(False)) | F.col("garbled"))
    return judged.select("doc_id", "page", "chars", "replacements", "spans", "longest", "strong", "garbled", "needs_ocr")


def document_profile(documents: DataFrame) -> DataFrame:
    """documents (pdf_type, pages, with_tables, with_columns, needing_ocr, ...) with mix, kind and confidence."""
    table_share, text_share = F.col("with_tables") / F.col("pages"), F.greatest(F.col("pages") - F.col("needing_ocr"), F.lit(0)) / F.col("pages")
    mix = (
        F.when(F.col("pages") == 0, "mixed")
        .when(F.col("pdf_type").isin("scanned", "image_based"), "image_dense")
        .when(table_share > TABLE_SHARE, "table_dense")
        .when((F.col("pdf_type") == "text_based") & (text_share > TEXT_SHARE), "text_dominant")
        .otherwise("mixed")
    )
    got = documents.withColumn("mix", mix)
    kind = F.when(F.col("pages") == 0, "unknown").when(F.col("mix") == "text_dominant", "report").when((F.col("pages") <= 2) & (F.col("with_columns") > 0), "resume").otherwise("unknown")
    got = got.withColumn("kind", kind)
    return got.withColumn("confidence", F.when(F.col("pages") == 0, 0.1).when(F.col("kind") == "report", 0.8).when(F.col("kind") == "resume", 0.6).otherwise(0.3))
