"""From the positioned items of PDF files to Markdown, a page and a document at a time.

What each line is, is worked out by expressions over all pages at once; only putting a page's lines together, which
needs to know what went before, runs a page at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.functions import lines as L
from pagelathe.functions import text as X
from pagelathe.lineage import cut
from pagelathe.operators import columns as C
from pagelathe.operators import documents as D
from pagelathe.operators import items as I
from pagelathe.operators import layout as P

# Fixed values.
LIST_BEFORE, LIST_AFTER, LIST_GAP = 5.0, 50.0, 7.0
MOST_HEADING_WORDS, LEAST_HEADING_BYTES = 15, 3
RARITY_WEIGHT, BOLD_WEIGHT, ALONE_WEIGHT, ISOLATED_WEIGHT, LEAST_SCORE = 0.5, 0.3, 0.2, 0.3, 0.5
RARE, MOST_RARE_WORDS, LEAST_SIZE = 0.97, 8, 0.95


@dataclass(frozen=True)
class MarkdownOptions:
    """compact also squeezes dot leaders; everything else keeps the text as it is."""

    compact: bool = False
    headings: bool = True
    lists: bool = True
    code: bool = True
    page_numbers_out: bool = True
    link_urls: bool = True
    join_hyphens: bool = True
    emphasis: bool = True
    underline: bool = True
    page_marks: bool = False
    running_lines_out: bool = True


def pdf_lines(items: DataFrame, options: MarkdownOptions | None = None) -> DataFrame:
    """(doc_id, page, line_no, y, x, text, marked, first_size, first_bold, bold, all_bold, code) of items, in reading order."""
    options = options or MarkdownOptions()
    own = items.drop("line_no", "line_y", "threshold")
    runs = cut(I.unspaced(own, I.letter_spacing(own)))
    placed = cut(runs.join(C.reading_lines(runs), ["doc_id", "page", "item_no"]))
    plain = placed.withColumn("is_underline", F.col("is_underline") & F.lit(options.underline))
    if not options.emphasis:
        plain = plain.withColumn("is_bold", F.lit(False)).withColumn("is_italic", F.lit(False))
    texts = I.line_texts(plain)
    order = F.struct("x", "item_no")
    letters = F.length(L.utrim(F.col("text")))
    shape = placed.groupBy("doc_id", "page", "line_no").agg(
        F.first("line_y").alias("y"), F.min("x").alias("x"), F.min_by("font_size", order).alias("first_size"), F.min_by("is_bold", order).alias("first_bold"),
        (F.sum(F.when(F.col("is_bold"), letters).otherwise(0)) * 2 >= F.sum(letters)).alias("bold"), F.bool_and("is_bold").alias("all_bold"), F.bool_or(L.is_monospace_font(F.col("font"))).alias("code"),
    )
    lines = texts.join(shape, ["doc_id", "page", "line_no"])
    lines = cut(lines)
    return cut(D.strip_running_lines(lines)) if options.running_lines_out else lines


def line_kinds(lines: DataFrame, items: DataFrame, options: MarkdownOptions | None = None) -> DataFrame:
    """lines of pdf_lines() with kind, caption, heading, list, code, text or blank, level, leaders, base and threshold.

    A heading is a line of a heading's size, or one that its rare size, weight and standing alone make one.
    """
    options = options or MarkdownOptions()
    base, rarity = P.base_font_size(items), P.font_rarity(items).select("doc_id", F.col("font_size").alias("first_size"), "rarity")
    known = lines.join(base, "doc_id").join(P.heading_tiers(lines, base), "doc_id", "left").join(P.paragraph_threshold(lines, base), "doc_id").join(rarity, ["doc_id", "first_size"], "left")
    page = Window.partitionBy("doc_id", "page").orderBy("line_no")
    up, down = F.lag("y").over(page) - F.col("y"), F.col("y") - F.lead("y").over(page)
    free = lambda gap: F.coalesce(F.abs(gap) > F.col("threshold"), F.lit(True))
    known = known.withColumn("_alone", free(up)).withColumn("_isolated", free(up) & free(down)).withColumn("tiers", F.coalesce("tiers", F.array().cast("array<double>")))
    t = L.utrim(F.col("text"))
    words = F.size(F.filter(F.split(t, r"[\s\p{Z}]+"), lambda w: w != ""))
    by_size = P.heading_level(F.col("first_size"), F.col("base"), F.col("tiers"), F.col("bold"))
    score = F.coalesce("rarity", F.lit(0.0)) * RARITY_WEIGHT + F.when(F.col("all_bold"), BOLD_WEIGHT).otherwise(0.0) + F.when(F.col("_alone"), ALONE_WEIGHT).otherwise(0.0) + F.when(F.col("_isolated"), ISOLATED_WEIGHT).otherwise(0.0)
    strong = F.col("all_bold") | F.col("_isolated") | ((F.col("rarity") >= RARE) & (words <= MOST_RARE_WORDS))
    enough = (words >= 2) | (F.col("all_bold") & (F.octet_length(t) >= 4))
    section = F.col("all_bold") & t.rlike(r"^[0-9]+(?:\.[0-9]+)*[.)]?\s+\S")
    alone = (F.col("first_size") >= F.col("base") * LEAST_SIZE) & (section | ((score >= LEAST_SCORE) & F.col("_alone") & enough & strong))
    may = (F.octet_length(t) > LEAST_HEADING_BYTES) & (words <= MOST_HEADING_WORDS) & ~t.rlike("^[•●○◦] ") & ~L.is_toc_entry(t) & ~L.is_heading_fragment(t) & ~F.col("code")
    level = F.when(may & F.lit(options.headings), F.coalesce(by_size, F.when(alone, F.least(F.size("tiers") + 1, F.lit(4)).cast("int"))))
    known = known.withColumn("level", level)
    kind = (
        F.when(t == "", "blank").when(L.is_caption(t), "caption").when(F.col("level").isNotNull(), "heading").when(F.lit(options.lists) & L.is_list_item(t), "list").when(F.lit(options.code) & F.col("code"), "code").otherwise("text")
    )
    return known.withColumn("kind", kind).withColumn("leaders", L.has_dot_leaders(t)).drop("_alone", "_isolated", "tiers", "rarity")


def _assembled(rows: list[dict]) -> str:
    """A page's lines, in order, as Markdown."""
    out: list[str] = []
    state, last_y, list_x, leaders, prev_y = "", None, None, False, None
    for r in rows:
        text, plain = r["marked"].strip(), r["text"].strip()
        gap = None if prev_y is None else prev_y - r["y"]
        broken = gap is None or abs(gap) > r["threshold"]
        prev_y = r["y"]
        kind = r["kind"]
        if kind == "blank":
            continue
        follows = list_x is not None and gap is not None and list_x - LIST_BEFORE <= r["x"] <= list_x + LIST_AFTER
        if kind == "heading" and state == "list" and follows and 0 <= gap <= r["threshold"]:
            kind = "text"  # a bold line within a list item
        if state == "code" and kind != "code":
            out.append("```\n")
            state = ""
        if state == "text" and (broken or kind != "text"):
            out.append("\n\n")
            state = ""
        if kind in ("caption", "heading"):
            shown = plain if kind == "heading" else text
            if state == "list":
                out.append("\n")
            out.append(("#" * r["level"] + " " if kind == "heading" else "") + shown + "\n\n")
            state, list_x = "", None
        elif kind == "list":
            out.append(r["item"] + "\n")
            state, list_x = "list", r["x"]
        elif kind == "text" and state == "list" and follows and gap < r["base"] * LIST_GAP and not r["leaders"]:
            out[-1] = out[-1].rstrip("\n") + " "
            out.append(text + "\n")
        elif kind == "code":
            out.append(("" if state == "code" else "```\n") + plain + "\n")
            state, list_x = "code", None
        else:
            if state == "text":
                out.append("\n" if r["leaders"] or leaders else " ")
            elif state == "list":
                out.append("\n")
            out.append(text)
            state, list_x, leaders = "text", None, r["leaders"]
    if state == "code":
        out.append("```\n")
    return "".join(out).strip("\n")


def cleaned(markdown: Column, options: MarkdownOptions) -> Column:
    """Words broken at line ends joined, bare addresses linked, empty lines squeezed; with compact also leaders and blanks."""
    out = markdown
    if options.compact:
        out = F.regexp_replace(F.regexp_replace(out, r"\.{4,}", " ... "), r"[ \t]{2,}", " ")
    if options.join_hyphens:
        out = F.regexp_replace(out, r"([a-z])-\n([a-z])", "$1$2")
    if options.link_urls:
        out = X.link_urls(out)
    return F.regexp_replace(F.regexp_replace(out, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")


def page_markdown(kinds: DataFrame, options: MarkdownOptions | None = None) -> DataFrame:
    """(doc_id, page, markdown) of lines of line_kinds()."""
    options = options or MarkdownOptions()

    def work(page: pa.Table) -> pa.Table:
        rows = page.sort_by("line_no").to_pylist()
        return pa.table({"doc_id": page.column("doc_id").slice(0, 1), "page": page.column("page").slice(0, 1), "markdown": pa.array([_assembled(rows)], pa.string())})

    types = dict(kinds.dtypes)
    seen = kinds.where(~L.is_page_number(F.col("text")) | (F.col("kind") == "blank")) if options.page_numbers_out else kinds
    slim = seen.select("doc_id", "page", "line_no", "y", "x", "text", "marked", "kind", "level", "leaders", "base", "threshold", L.format_list_item(L.utrim(F.col("marked"))).alias("item"))
    made = slim.groupBy("doc_id", "page").applyInArrow(lambda p: work(p), f"doc_id {types['doc_id']}, page {types['page']}, markdown string")
    return made.withColumn("markdown", cleaned(F.col("markdown"), options))


def document_markdown(pages: DataFrame, options: MarkdownOptions | None = None) -> DataFrame:
    """(doc_id, markdown): the pages in order, an empty line between, with marks if options ask for them."""
    options = options or MarkdownOptions()
    mark = F.concat(F.lit("<!-- Page "), F.col("page").cast("string"), F.lit(" -->\n\n")) if options.page_marks else F.lit("")
    got = pages.where("markdown <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", F.concat(mark, F.col("markdown")).alias("m")))).alias("p"))
    return got.select("doc_id", F.concat(F.array_join(F.transform("p", lambda x: x["m"]), "\n\n"), F.lit("\n")).alias("markdown"))


def styled(items: DataFrame) -> DataFrame:
    """Rows of files.pdf_items() as the operators on items take them: path as doc_id, weight and slant from the font's name."""
    return items.select(
        F.col("path").alias("doc_id"), "page", "item_no", "text", "x", "y", "width", "height", "font_size", F.coalesce("font", F.lit("")).alias("font"), F.coalesce(L.is_bold_font(F.col("font")), F.lit(False)).alias("is_bold"),
        F.coalesce(L.is_italic_font(F.col("font")), F.lit(False)).alias("is_italic"), F.lit(False).alias("is_underline"),
    )


def markdown_of_items(items: DataFrame, options: MarkdownOptions | None = None) -> DataFrame:
    """(doc_id, markdown) of positioned items: letter spacing, columns, lines, kinds, pages, documents."""
    lines = pdf_lines(items, options)
    return document_markdown(page_markdown(line_kinds(lines, items, options), options), options)
