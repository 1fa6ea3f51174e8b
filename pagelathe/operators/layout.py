"""Operators on positioned text items and boxes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.functions import geometry as G
from pagelathe.functions import lines as L
from pagelathe.functions import text as X
from pagelathe.operators.ranges import banded, shares_band

# Fixed values.
LEAST_FONT, DEFAULT_FONT = 9.0, 12.0
ROW_SHARE, LEAST_ROW, SPACE_SHARE = 0.6, 1.0, 0.15
PARAGRAPH_GAP, PARAGRAPH_SHIFT = 8, 20
TIER_RATIO, BOLD_RATIO, TIER_APART, MOST_TIERS = 1.2, 1.05, 0.5, 4
REGION_MARGIN, UNKNOWN_WIDTH = 1.5, 0.5
FINANCIAL_WIDTH, LEAST_VALUES = 20, 3


def base_font_size(items: DataFrame) -> DataFrame:
    """(doc_id, base): the most frequent size of LEAST_FONT or more, in tenths; of equally frequent ones the smaller."""
    sized = items.withColumn("_k", F.when(F.col("font_size") >= LEAST_FONT, F.floor(F.col("font_size") * 10).cast("long")))
    counts = sized.groupBy("doc_id", "_k").count()
    best = F.max_by("_k", F.when(F.col("_k").isNotNull(), F.struct("count", -F.col("_k"))))
    return counts.groupBy("doc_id").agg(F.coalesce(best / 10.0, F.lit(DEFAULT_FONT)).alias("base"))


def font_rarity(items: DataFrame) -> DataFrame:
    """(doc_id, font_size, items, rarity): one less the share of a document's items that have the size."""
    counts = items.groupBy("doc_id", "font_size").agg(F.count("*").alias("items"))
    return counts.withColumn("rarity", 1 - F.col("items") / F.sum("items").over(Window.partitionBy("doc_id")))


def heading_tiers(lines: DataFrame, base: DataFrame) -> DataFrame:
    """(doc_id, tiers) of lines (doc_id, text, first_size, first_bold): the sizes of headings, largest first, TIER_APART apart.

    They are the sizes of first items of TIER_RATIO times the base and more, of lines without letters none; where there
    are none, those of bold first items of BOLD_RATIO times the base and more, of lines with a letter.
    """
    ratio, t = F.col("first_size") / F.col("base"), L.utrim(F.col("text"))
    letter = t.rlike(r"\p{L}")
    size = F.col("first_size").cast("double")
    sizes = lines.join(base, "doc_id").groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.when((ratio >= TIER_RATIO) & (letter | (t == "")), size)), asc=False).alias("large"),
        F.sort_array(F.collect_set(F.when((ratio >= BOLD_RATIO) & F.col("first_bold") & letter, size)), asc=False).alias("bold"),
    )
    none = F.array().cast("array<double>")
    apart = F.aggregate(F.when(F.size("large") > 0, F.col("large")).otherwise(F.col("bold")), none, lambda a, x: F.when(F.exists(a, lambda y: F.abs(y - x) < TIER_APART), a).otherwise(F.concat(a, F.array(x))))
    return sizes.select("doc_id", F.slice(apart, 1, MOST_TIERS).alias("tiers")).where(F.size("tiers") > 0)


def heading_level(size: Column, base: Column, tiers: Column, bold: Column) -> Column:
    """1 to 6 of a line, null for none."""
    ratio = size / base
    near = F.array_position(F.transform(tiers, lambda t: F.abs(t - size) < TIER_APART), F.lit(True)).cast("int")
    many = F.size(tiers)
    open_ended = F.when(ratio >= 2.0, 1).when(ratio >= 1.5, 2).when(ratio >= 1.25, 3).otherwise(4)
    large = F.when(near > 0, near).when(many == 0, open_ended).when(ratio >= 1.5, F.least(many + 1, F.lit(4)))
    return F.when(ratio >= TIER_RATIO, large).when((ratio >= BOLD_RATIO) & bold & (near > 0), near)


def item_lines(items: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, text, y, right, first_size, first_bold): items of a page in rows from the top, joined with
    blanks at wide gaps; the last two are those of the leftmost item.

    An item is of its predecessor's row, in the order of descending y, if their centres differ by no more than
    ROW_SHARE of the greater height. y grows upwards.
    """
    page = Window.partitionBy("doc_id", "page").orderBy(F.desc("y"), "x", "item_no")
    centre = F.col("y") + F.col("height") / 2
    rows = (
        items.where(F.regexp_replace("text", r"[\s\p{Z}]", "") != "")
        .withColumn("_c", centre)
        .withColumn("_far", F.abs(F.col("_c") - F.lag("_c").over(page)))
        .withColumn("_may", F.greatest(F.greatest("height", F.lag("height").over(page)) * ROW_SHARE, F.lit(LEAST_ROW)))
        .withColumn("_new", F.coalesce((F.col("_far") > F.col("_may")).cast("int"), F.lit(0)))
        .withColumn("line_no", F.sum("_new").over(page))
    )
    row = Window.partitionBy("doc_id", "page", "line_no").orderBy("x", "item_no")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(row)
    spaced = rows.withColumn("_t", F.concat(F.when(gap > F.col("font_size") * SPACE_SHARE, " ").otherwise(""), F.col("text")))
    got = spaced.groupBy("doc_id", "page", "line_no").agg(
        F.array_sort(F.collect_list(F.struct("x", "item_no", "_t", "font_size", "is_bold"))).alias("l"), F.max("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("right")
    )
    return got.select("doc_id", "page", "line_no", F.array_join(F.transform("l", lambda i: i["_t"]), "").alias("text"), "y", "right", F.col("l")[0]["font_size"].alias("first_size"), F.col("l")[0]["is_bold"].alias("first_bold"))


def paragraph_threshold(lines: DataFrame, base: DataFrame) -> DataFrame:
    """(doc_id, threshold): the gap between lines from which a paragraph ends. The upper median of sane gaps, scaled."""
    order = Window.partitionBy("doc_id", "page").orderBy("line_no")
    gaps = lines.withColumn("gap", F.lag("y").over(order) - F.col("y")).join(base, "doc_id").where((F.col("gap") > 0) & (F.col("gap") < F.col("base") * 10))
    sane = gaps.groupBy("doc_id").agg(F.array_sort(F.collect_list("gap")).alias("g"))
    median = F.get("g", F.floor(F.size("g") / 2).cast("int"))
    found = F.when(F.size("g") >= 5, F.greatest(median * 1.3, F.col("base") * 1.5))
    return base.join(sane, "doc_id", "left").select("doc_id", F.coalesce(found, F.col("base") * 1.8).alias("threshold"))


def keep_boxes(boxes: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, page, idx, x0, y0, x1, y1) of the boxes kept by greedy overlap removal, in the order of idx."""
    b = F.struct("idx", G.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("box"))
    got = boxes.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(b), lambda p, q: p["idx"].cast("int") - q["idx"].cast("int")).alias("b"))
    return got.select("doc_id", "page", F.inline(G.keep_by_iou(F.col("b"), threshold))).select("doc_id", "page", "idx", "box.*")


def gap_bands(boxes: DataFrame, axis: str = "x") -> DataFrame:
    """boxes with band: along an axis, a band ends where a box begins at or beyond the end of all before."""
    a, z = f"{axis}0", f"{axis}1"
    order = Window.partitionBy("doc_id", "page").orderBy(a, z, "idx")
    before = F.max(z).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return boxes.withColumn("_new", F.coalesce((F.col(a) >= before).cast("int"), F.lit(0))).withColumn("band", F.sum("_new").over(order)).drop("_new")


def _cut(boxes: list[tuple[int, int, int, int]], members: list[int], out: list[int]) -> None:
    """Appends members in reading order: split at gaps in x, else in y, else by y and x."""
    work = [members]
    while work:
        own = work.pop()
        for axis in (0, 1) if len(own) > 1 else ():
            by_start = sorted(own, key=lambda k: boxes[k][axis])
            bands, end = [[by_start[0]]], boxes[by_start[0]][axis + 2]
            for k in by_start[1:]:
                if boxes[k][axis] < end:
                    bands[-1].append(k)
                else:
                    bands.append([k])
                end = max(end, boxes[k][axis + 2])
            if len(bands) > 1:
                work.extend(reversed(bands))
                break
        else:
            out.extend(sorted(own, key=lambda k: (boxes[k][1], boxes[k][0])))


def reading_order(boxes: DataFrame) -> DataFrame:
    """(doc_id, page, idx, reading_order) by recursive cuts. Pages are independent; the recursion needs a whole page."""

    def order(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        corners = list(zip(*(rows.column(c).to_pylist() for c in ("x0", "y0", "x1", "y1")), strict=True))
        out: list[int] = []
        _cut(corners, list(range(len(corners))), out)
        rank = [0] * len(out)
        for place, k in enumerate(out):
            rank[k] = place
        return rows.select(["doc_id", "page", "idx"]).append_column("reading_order", pa.array(rank, pa.int32()))

    kinds = dict(boxes.dtypes)
    slim = boxes.select("doc_id", "page", "idx", *[F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return slim.groupBy("doc_id", "page").applyInArrow(lambda t: order(t), ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", "page", "idx")) + ", reading_order int")


def merge_paragraphs(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, first_idx, n_merged, text, x0, y0, x1, y1): text blocks close below what was merged before join it.

    The gap is from 0 to PARAGRAPH_GAP, the left edges differ by at most PARAGRAPH_SHIFT; both are measured against the
    union of all that was merged. Other categories stand alone and break a run.
    """
    fields = ("idx", "category", "text", "x0", "y0", "x1", "y1")
    got = blocks.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("b"))
    as_run = lambda b: F.struct(b["idx"].alias("first_idx"), F.lit(1).alias("n_merged"), b["category"].alias("category"), *[b[c].alias(c) for c in fields[2:]])
    none = F.transform(F.filter("b", lambda x: F.lit(False)), as_run)

    def step(runs: Column, b: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        gap = b["y0"] - last["y1"]
        joins = (b["category"] == "text") & (last["category"] == "text") & gap.between(0, PARAGRAPH_GAP) & (F.abs(b["x0"] - last["x0"]) <= PARAGRAPH_SHIFT)
        union = F.struct(
            last["first_idx"].alias("first_idx"), (last["n_merged"] + 1).alias("n_merged"), last["category"].alias("category"), F.concat_ws(" ", last["text"], b["text"]).alias("text"),
            F.least(last["x0"], b["x0"]).alias("x0"), F.least(last["y0"], b["y0"]).alias("y0"), F.greatest(last["x1"], b["x1"]).alias("x1"), F.greatest(last["y1"], b["y1"]).alias("y1"),
        )
        return F.when((F.size(runs) > 0) & joins, F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(union))).otherwise(F.concat(runs, F.array(as_run(b))))

    return got.select("doc_id", "page", F.inline(F.aggregate("b", none, step)))


def effective_width(item: Column) -> Column:
    """An item's width, or a guess from its letters where it has none."""
    return F.when(item["width"] > 0, item["width"]).otherwise(F.length(item["text"]) * item["font_size"] * UNKNOWN_WIDTH)


def items_in_regions(items: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, page, region_id, n_items, width): the items that overlap a region of their page, or come within REGION_MARGIN of it."""
    i = banded(items.withColumn("_w", effective_width(F.struct("width", "text", "font_size"))), F.col("y") - REGION_MARGIN, F.col("y") + F.col("height") + REGION_MARGIN).alias("i")
    r = banded(regions, F.col("y0"), F.col("y1")).alias("r")
    wide = F.least(F.col("i.x") + F.col("i._w"), F.greatest("r.x0", "r.x1") + REGION_MARGIN) - F.greatest(F.col("i.x"), F.least("r.x0", "r.x1") - REGION_MARGIN)
    high = F.least(F.col("i.y") + F.col("i.height"), F.greatest("r.y0", "r.y1") + REGION_MARGIN) - F.greatest(F.col("i.y"), F.least("r.y0", "r.y1") - REGION_MARGIN)
    return i.join(r, shares_band("i", "r") & (wide > 0) & (high > 0)).groupBy("r.doc_id", "r.page", "r.region_id").agg(F.count("*").alias("n_items"), F.sum("i._w").alias("width"))


def snapped(values: DataFrame, tolerance: float) -> DataFrame:
    """(doc_id, cluster, n, low, high): sorted values cut where the step is wider than tolerance."""
    order = Window.partitionBy("doc_id").orderBy("value")
    cut = values.withColumn("_new", F.coalesce((F.col("value") - F.lag("value").over(order) > tolerance).cast("int"), F.lit(0))).withColumn("cluster", F.sum("_new").over(order))
    return cut.groupBy("doc_id", "cluster").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


def folio_pairs(folios: DataFrame) -> DataFrame:
    """(doc_id, page, value) of numbers that grow by one from a page to the next, on either side of the pair."""
    a, b = folios.alias("a"), folios.alias("b")
    pair = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("b.page") == F.col("a.page") + 1) & (F.col("b.value") == F.col("a.value") + 1)
    both = a.join(b, pair).select(F.explode(F.array(F.struct("a.doc_id", "a.page", "a.value"), F.struct("b.doc_id", "b.page", "b.value"))).alias("f"))
    return both.select("f.*").distinct()



def split_financial(items: DataFrame) -> DataFrame:
    """items with part: a wide item of three amounts or more, without words, becomes an item an amount, evenly spread."""
    values = X.financial_values(F.col("text"))
    wide = (F.col("width") > F.col("font_size") * FINANCIAL_WIDTH) & ~F.col("text").rlike(r"\p{L}{2}")
    parts = items.withColumn("_v", F.when(wide & (F.size(values) >= LEAST_VALUES), values)).withColumn("_n", F.coalesce(F.size("_v"), F.lit(1)))
    each = parts.select("*", F.posexplode(F.coalesce("_v", F.array("text"))).alias("part", "_t"))
    step = F.col("width") / F.col("_n")
    split = F.col("_v").isNotNull()
    out = {"text": F.col("_t"), "x": F.when(split, F.col("x") + step * (F.col("part") + 0.5)).otherwise(F.col("x")), "width": F.when(split, step * 0.9).otherwise(F.col("width"))}
    return each.select(*[out.get(c, F.col(c)).alias(c) for c in items.columns], "part")
