"""From positioned text items to lines: order, joins, emphasis, rotation, rules and clusters.

Items are rows (doc_id, page, item_no, text, x, y, width, height, font_size, font, is_bold, is_italic, is_underline) in
the order of their stream; y grows upwards. Everything is keyed by document and page, so a document is never one task's
whole work, and all but rect_clusters() are expressions and windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.functions import lines as L
from pagelathe.functions import text as X
from pagelathe.operators.layout import effective_width

# Fixed values.
JOIN_DEFAULT, SPACED_FROM = 0.10, 0.20
LEAST_SPACED_ITEMS, LEAST_SINGLE_ITEMS, LEAST_RATIOS, LEAST_RATIO = 4, 10, 8, 0.40
SCRIPT_RATIO, SCRIPT_SHIFT = 0.85, 1.0
LINE_TOLERANCE, LINE_SHIFT, SAME_LEFT, BACK_TRACK = 3.0, 0.5, 5.0, 10.0
JUMP, LEAST_JUMPS, CHAOS = 50.0, 3, 0.4
VOID_EM, LEAST_VOID = 3.0, 30.0
RULE_THICKNESS, LEAST_RULE = 2.0, 1.0
BAND_SHARE = 0.7
Y_CLUSTER, X_CLUSTER = 3.0, 8.0
ROW_SHARE, LEAST_ROW_STEP, NEAREST_ROW = 0.8, 4.0, 15.0
COLUMN_NEAR = (25.0, 50.0)
X_BUCKET = 24.0
FOLIO_TOP, FOLIO_BOTTOM = 720.0, 100.0
CONTAINERS = ["Document", "Part", "Art", "Sect", "Div", "NonStruct", "Span", "Private"]
LEAST_TAGGED, MOST_OF_LEVEL = 20, 0.15
CLOSING_MARKS = [".", ",", ";", "!", "?", ")", "]", "}", "'"]
CID_FONTS = "^C[02]_"


def _chars(text: Column) -> Column:
    return F.length(L.utrim(text))


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\s\p{Z}]+"), lambda w: w != ""))


def joins(prev: Column, cur: Column, threshold: Column) -> Column:
    """Whether cur goes on in prev's word: structs (text, x, width, font_size, font) that stand side by side.

    threshold is that of letter_spacing() for the page. The first rule that holds decides.
    """
    size, width = prev["font_size"], prev["width"]
    p, c = F.right(L.utrim(prev["text"]), F.lit(1)), F.left(L.utrim(cur["text"]), F.lit(1))
    n_prev, n_cur = _chars(prev["text"]), _chars(cur["text"])
    cjk = p.rlike(X.CJK) | c.rlike(X.CJK)
    gap = F.when(prev["x"] <= cur["x"], cur["x"] - (prev["x"] + width)).otherwise(prev["x"] - (cur["x"] + cur["width"]))
    lower = lambda x: x.rlike(r"^\p{Ll}$")
    upper = lambda x: x.rlike(r"^\p{Lu}$")
    numeric = (p.rlike("^[0-9,.]$") & c.rlike("^[0-9%.]$")) | (p.rlike("^[+-]$") & c.rlike("^[0-9]$"))
    digits = p.rlike("^[0-9,.%+-]$") & c.rlike("^[0-9,.%]$")
    known = (
        F.when((gap > size * 3) | (gap < -size), False)
        .when(~cjk & (gap >= 0) & (gap < size * 0.01) & prev["font"].rlike(CID_FONTS), _words(prev["text"]) >= 3)
        .when(numeric, (gap > -size) & (gap < size * 0.3))
        .when((threshold > SPACED_FROM) & (n_prev == 1), gap < width * 1.25)
        .when((threshold > SPACED_FROM) & (n_cur == 1), gap < width / n_prev * 1.25)
        .when(threshold > SPACED_FROM, gap < size * threshold)
        .when((n_prev == 1) != (n_cur == 1), gap < size * 0.20)
        .when((n_prev == 1) & digits, gap < size * 0.25)
        .when(n_prev == 1, gap < size * threshold)
        .when((n_prev >= 2) & (n_cur >= 2) & lower(p) & lower(c), gap < size * 0.18)
        .otherwise(gap < size * 0.15)
    )
    char = size * 0.45
    guessed = cur["x"] - (prev["x"] + F.length(prev["text"]) * char)
    letters = p.rlike(r"^\p{L}$") & c.rlike(r"^\p{L}$")
    unknown = (
        F.when(guessed > char * 6, False)
        .when(cjk, guessed < char * 0.8)
        .when(letters & ((upper(p) & upper(c)) | (lower(p) & lower(c))), guessed < char * 0.8)
        .when(letters & lower(p) & upper(c), False)
        .when(letters, guessed < char * 0.3)
        .otherwise(guessed < char * 0.5)
    )
    return (
        F.when(prev["text"].endswith(" ") | cur["text"].startswith(" "), False)
        .when(c.isin(CLOSING_MARKS), True)
        .when((p == ":") & c.rlike(r"^[\p{L}\p{N}]$"), False)
        .when(width > 0, known)
        .otherwise(unknown)
    )


def letter_spacing(items: DataFrame) -> DataFrame:
    """(doc_id, page, threshold, spaced): the join threshold of a page and whether its texts have blanks between letters.

    A page counts as spaced out if half of its longer items, or of all its items as single letters, look so; its
    threshold then follows the median gap in terms of the font size.
    """
    page = Window.partitionBy("doc_id", "page").orderBy("item_no")
    t = L.utrim(F.col("text"))
    prev = F.lag(F.struct("text", "x", "width", "font_size")).over(page)
    seen = items.withColumn("_p", prev).withColumn("_t", t)
    gap = F.when(F.col("_p.x") <= F.col("x"), F.col("x") - (F.col("_p.x") + F.col("_p.width"))).otherwise(F.col("_p.x") - (F.col("x") + F.col("width")))
    cjk = F.right(L.utrim(F.col("_p.text")), F.lit(1)).rlike(X.CJK) | F.left("_t", F.lit(1)).rlike(X.CJK)
    ratio = F.when((F.col("_p.width") > 0) & (F.col("_p.font_size") > 0) & ~cjk, gap / F.col("_p.font_size"))
    sums = seen.withColumn("_r", ratio).groupBy("doc_id", "page").agg(
        F.count("*").alias("n"), F.sum((F.length("_t") == 1).cast("int")).alias("single"), F.sum((F.octet_length("_t") >= 3).cast("int")).alias("long"),
        F.sum(((F.octet_length("_t") >= 3) & F.col("_t").rlike("^[^ ](?: [^ ])+$")).cast("int")).alias("spaced"),
        F.array_sort(F.collect_list(F.when(F.col("_r").between(0, 3), F.col("_r")))).alias("r"),
    )
    median = F.get("r", F.floor(F.size("r") / 2).cast("int"))
    wide = (F.size("r") >= LEAST_RATIOS) & (F.get("r", F.lit(0)) >= LEAST_RATIO)
    adaptive = F.when(wide, F.greatest(F.lit(0.50), F.least(F.lit(2.0), median * 1.55))).otherwise(JOIN_DEFAULT)
    by_text = (F.col("long") >= LEAST_SPACED_ITEMS) & (F.col("spaced") * 2 >= F.col("long"))
    by_letter = (F.col("n") >= LEAST_SINGLE_ITEMS) & (F.col("single") * 2 >= F.col("n"))
    threshold = F.when(by_text, adaptive).when(by_letter & (adaptive > LEAST_RATIO), adaptive).otherwise(JOIN_DEFAULT)
    return sums.select("doc_id", "page", threshold.alias("threshold"), by_text.alias("spaced"))


def unspaced(items: DataFrame, spacing: DataFrame) -> DataFrame:
    """items with threshold, and without the blanks between letters on pages that are spaced out."""
    fixed = F.when(F.col("spaced") & L.utrim(F.col("text")).rlike("^[^ ](?: [^ ])+$"), F.replace("text", F.lit(" "), F.lit(""))).otherwise(F.col("text"))
    return items.join(spacing, ["doc_id", "page"]).withColumn("text", fixed).drop("spaced")


def grouped_lines(items: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """(keys, item_no, line_no, line_y): the items of one column in lines, in stream order unless that jumps about.

    An item opens a line if it is off the last line's height; if, a little off, it begins where that line began or goes
    back; or if a wide void parts two pieces of prose of which the second goes on in lower case or in another weight.
    """
    stream = Window.partitionBy(*keys).orderBy("item_no")
    t = L.utrim(F.col("text"))
    step = F.col("y") - F.lag("y").over(stream)
    seen = items.withColumn("_step", step).select(
        *keys, "item_no", "x", "y", "width", "font_size", "is_bold", F.col("_step"), _words(t).alias("words"), F.regexp_count(t, F.lit(r"\p{L}")).alias("letters"), F.regexp_extract(t, r"^(\p{L})", 1).alias("first")
    )
    item = F.struct("item_no", "x", "y", "width", "font_size", "is_bold", "words", "letters", "first")
    pages = seen.groupBy(*keys).agg(
        F.collect_list(item).alias("items"), F.count("*").alias("n"), F.sum((F.col("_step") > JUMP).cast("int")).alias("up"), F.sum((F.col("_step") < -JUMP).cast("int")).alias("down")
    )
    up, down = F.coalesce("up", F.lit(0)), F.coalesce("down", F.lit(0))
    chaotic = (F.col("n") >= 5) & (up + down >= LEAST_JUMPS) & (up > (up + down) * CHAOS)
    place = lambda i: F.struct(F.when(F.col("_sort"), -i["y"]).otherwise(F.lit(0.0)).alias("a"), F.when(F.col("_sort"), i["x"]).otherwise(F.lit(0.0)).alias("b"), i["item_no"].alias("c"), i.alias("i"))
    ordered = pages.withColumn("_sort", chaotic).withColumn("items", F.array_sort(F.transform("items", place)))
    none = F.struct(
        F.lit(0).alias("line"), F.lit(0.0).alias("y"), F.lit(0.0).alias("first_x"), F.lit(0.0).alias("last_x"), F.lit(0.0).alias("right"), F.lit(0.0).alias("size"), F.lit(True).alias("bold"), F.lit(0).alias("words"), F.lit(0).alias("letters"),
        F.array().cast("array<struct<item_no:bigint,line_no:int,line_y:double>>").alias("out"),
    )

    def add(s: Column, placed: Column) -> Column:
        i = placed["i"]
        off = F.abs(s["y"] - i["y"])
        stacked = (off > LINE_SHIFT) & ((F.abs(i["x"] - s["first_x"]) < SAME_LEFT) | (i["x"] < s["last_x"] - BACK_TRACK))
        void = i["x"] - s["right"] > F.greatest(F.greatest(i["font_size"], s["size"]) * VOID_EM, F.lit(LEAST_VOID))
        prose = (s["words"] >= 2) & (s["letters"] >= 8) & (i["words"] >= 3) & (i["letters"] >= 10)
        parted = void & (i["first"] != "") & prose & (i["first"].rlike(r"^\p{Ll}$") | (s["bold"] & ~i["is_bold"]))
        new = (F.size(s["out"]) == 0) | (off >= LINE_TOLERANCE) | stacked | parted
        line = F.when(F.size(s["out"]) == 0, 0).when(new, s["line"] + 1).otherwise(s["line"])
        keep = lambda old, fresh: F.when(new, fresh).otherwise(old)
        return F.struct(
            line.alias("line"), keep(s["y"], i["y"]).alias("y"), keep(s["first_x"], i["x"]).alias("first_x"), i["x"].alias("last_x"), (i["x"] + i["width"]).alias("right"), i["font_size"].alias("size"),
            keep(s["bold"] & i["is_bold"], i["is_bold"]).alias("bold"), keep(s["words"] + i["words"], i["words"]).alias("words"), keep(s["letters"] + i["letters"], i["letters"]).alias("letters"),
            F.concat(s["out"], F.array(F.struct(i["item_no"].cast("bigint").alias("item_no"), line.alias("line_no"), keep(s["y"], i["y"]).alias("line_y")))).alias("out"),
        )

    return ordered.select(*keys, F.inline(F.aggregate("items", none, add)["out"]))


def _reading(items: DataFrame) -> DataFrame:
    """items (with line_no) with _place: the order in their line, from the left, or from the right where more letters run so."""
    line = Window.partitionBy("doc_id", "page", "line_no")
    rtl = F.sum(F.regexp_count("text", F.lit(X.RTL))).over(line)
    other = F.sum(F.regexp_count(F.regexp_replace(F.regexp_replace("text", X.RTL, ""), X.CJK, ""), F.lit(r"\p{L}"))).over(line)
    return items.withColumn("_place", F.when((rtl > 0) & (rtl > other), -F.col("x")).otherwise(F.col("x")))


def item_joins(items: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, item_no, joined) of items with line_no and threshold; null for the first of a line."""
    line = Window.partitionBy("doc_id", "page", "line_no").orderBy("_place", "item_no")
    one = F.struct("text", "x", "width", "font_size", "font")
    pairs = _reading(items).withColumn("_p", F.lag(one).over(line)).withColumn("_i", one)
    return pairs.select("doc_id", "page", "line_no", "item_no", F.when(F.col("_p").isNotNull(), joins(F.col("_p"), F.col("_i"), F.col("threshold"))).alias("joined"))


def line_texts(items: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, text, marked) of items with line_no and threshold.

    text joins the items with blanks where they do not go on in one word; marked also has ** and * around bold and
    italic items and <u> around underlined ones, which take no other marks.
    """
    order = Window.partitionBy("doc_id", "page", "line_no").orderBy("_place", "item_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    one = F.struct("text", "x", "y", "width", "font_size", "font")
    t = L.utrim(F.col("text"))
    shown = F.when(t != "", F.struct(t.alias("t"), (F.col("is_bold") & ~F.col("is_underline")).alias("b"), (F.col("is_italic") & ~F.col("is_underline")).alias("i"), F.col("is_underline").alias("u")))
    rows = _reading(items).withColumn("_p", F.lag(one).over(order)).withColumn("_i", one).withColumn("_s", shown).withColumn("_q", F.last("_s", ignorenulls=True).over(before))
    p, i, s, q = F.col("_p"), F.col("_i"), F.col("_s"), F.col("_q")
    script = (F.abs(i["y"] - p["y"]) > SCRIPT_SHIFT) & ((i["font_size"] / p["font_size"] < SCRIPT_RATIO) | (p["font_size"] / i["font_size"] < SCRIPT_RATIO))
    hyphen = (t == "-") | i["text"].startswith("-")
    apart = ~(hyphen | script | joins(p, i, F.col("threshold")) | i["text"].startswith(" "))
    plain = F.concat(F.when(p.isNotNull() & apart & ~p["text"].rlike("[ -]$"), " ").otherwise(""), F.col("text"))
    was = lambda k: F.coalesce(q[k], F.lit(False))
    mark = lambda when, m: F.when(when, m).otherwise("")
    blank = q.isNotNull() & ((apart & ~q["t"].endswith("-")) | i["text"].startswith(" "))
    styled = F.concat(
        mark(was("i") & ~s["i"], "*"), mark(was("b") & ~s["b"], "**"), mark(was("u") & ~s["u"], "</u>"), mark(blank, " "),
        mark(s["u"] & ~was("u"), "<u>"), mark(s["b"] & ~was("b"), "**"), mark(s["i"] & ~was("i"), "*"), s["t"],
    )
    parts = rows.select("doc_id", "page", "line_no", F.struct("_place", "item_no", plain.alias("plain"), F.when(s.isNotNull(), styled).alias("styled"), s.alias("s")).alias("part"))
    got = parts.groupBy("doc_id", "page", "line_no").agg(F.array_sort(F.collect_list("part")).alias("l"))
    seen = F.filter("l", lambda x: x["s"].isNotNull())
    last = F.get(seen, F.size(seen) - 1)["s"]
    ending = F.concat(*[mark(F.coalesce(last[k], F.lit(False)), m) for k, m in (("i", "*"), ("b", "**"), ("u", "</u>"))])
    return got.select("doc_id", "page", "line_no", F.array_join(F.transform("l", lambda x: x["plain"]), "").alias("text"), F.concat(F.array_join(F.transform(seen, lambda x: x["styled"]), ""), ending).alias("marked"))


def turned(items: DataFrame, rects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items (with rotated) and rects of pages of which two thirds of the items are rotated, turned upright; others as they are."""
    votes = items.groupBy("doc_id", "page").agg(((F.count("*") >= 2) & (F.sum(F.col("rotated").cast("int")) * 3 >= F.count("*") * 2)).alias("_turn"))
    turn = F.coalesce("_turn", F.lit(False))
    on = lambda df, new: df.join(votes, ["doc_id", "page"], "left").select(*[F.when(turn, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns])
    guess = F.when(F.col("width") < 0.5, F.length("text") * F.col("font_size") * 0.5).otherwise(F.col("width"))
    upright = {"x": F.col("y"), "y": -F.col("x"), "width": guess}
    return on(items, upright), on(rects, {"x": F.col("y"), "y": -(F.col("x") + F.abs("width")), "width": F.col("height"), "height": F.col("width")})


def distinct_rects(rects: DataFrame) -> DataFrame:
    """rects (doc_id, page, rect_no, x, y, width, height), those alike on a grid of half points once: the first."""
    key = [F.col(c) for c in ("doc_id", "page")] + [(F.col(c) * 2).cast("int").alias(f"_{c}") for c in ("x", "y", "width", "height")]
    best = rects.groupBy(*key).agg(F.min(F.struct("rect_no", "x", "y", "width", "height")).alias("r"))
    return best.select("doc_id", "page", "r.*")


def rects_in_bands(rects: DataFrame, bands: DataFrame) -> DataFrame:
    """(doc_id, page, band, rect_no): narrow rects that touch a band (doc_id, page, band, x_lo, x_hi), wide ones mostly inside."""
    left, right = F.least("x", F.col("x") + F.col("width")), F.greatest("x", F.col("x") + F.col("width"))
    both = rects.join(bands, ["doc_id", "page"])
    inside = F.least(right, F.col("x_hi")) - F.greatest(left, F.col("x_lo"))
    narrow = right - left < (F.col("x_hi") - F.col("x_lo")) * BAND_SHARE
    return both.where((inside > 0) & (narrow | (inside >= (right - left) * BAND_SHARE))).select("doc_id", "page", "band", "rect_no")


def lines_in_bands(lines: DataFrame, bands: DataFrame) -> DataFrame:
    """(doc_id, page, band, line_no): drawn lines (x1, x2, ...) that reach into a band."""
    reach = (F.greatest("x1", "x2") > F.col("x_lo")) & (F.least("x1", "x2") < F.col("x_hi"))
    return lines.join(bands, ["doc_id", "page"]).where(reach).select("doc_id", "page", "band", "line_no")


def horizontal_rules(rects: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, page, x1, x2, y): thin level lines and flat rects, longer than a point, as rules."""
    level = (F.col("stroke_width") <= RULE_THICKNESS) & (F.abs(F.col("y1") - F.col("y2")) <= RULE_THICKNESS) & (F.abs(F.col("x2") - F.col("x1")) > LEAST_RULE)
    flat = (F.abs("height") <= RULE_THICKNESS) & (F.abs("width") > LEAST_RULE)
    drawn = lines.where(level).select("doc_id", "page", F.least("x1", "x2").alias("a"), F.greatest("x1", "x2").alias("b"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    filled = rects.where(flat).select("doc_id", "page", F.least("x", F.col("x") + F.col("width")).alias("a"), F.greatest("x", F.col("x") + F.col("width")).alias("b"), (F.col("y") + F.col("height") / 2).alias("y"))
    return drawn.union(filled).select("doc_id", "page", F.col("a").alias("x1"), F.col("b").alias("x2"), "y")


def rect_clusters(rects: DataFrame, tolerance: float, least: int) -> DataFrame:
    """(doc_id, page, rect_no, cluster): rects that touch, widened by tolerance, directly or through others.

    A cluster is named by its smallest rect_no; those of fewer than least rects leave no rows. A page is one group: each
    rect is compared with the later ones in one numpy step, in memory that grows with their number.
    """

    def work(page: pa.Table) -> pa.Table:
        page = page.sort_by("rect_no")
        x, y, w, h = (page.column(c).to_numpy().astype(np.float64) for c in ("x", "y", "width", "height"))
        left, right, low, high = x - tolerance, x + w + tolerance, y - tolerance, y + h + tolerance
        root = np.arange(len(x))
        for k in range(len(x) - 1):
            rest = slice(k + 1, None)
            near = k + 1 + np.flatnonzero(~((right[k] < left[rest]) | (right[rest] < left[k]) | (high[k] < low[rest]) | (high[rest] < low[k])))
            if len(near):
                found = np.unique(np.append(root[near], root[k]))
                root[np.isin(root, found)] = found[0]
        own, size = np.unique(root, return_counts=True)
        keep = np.isin(root, own[size >= least])
        numbers = page.column("rect_no").to_numpy()
        return page.select(["doc_id", "page", "rect_no"]).append_column("cluster", pa.array(numbers[root], pa.int64())).filter(pa.array(keep))

    kinds = dict(rects.dtypes)
    slim = rects.select("doc_id", "page", F.col("rect_no").cast("long").alias("rect_no"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")])
    return slim.groupBy("doc_id", "page").applyInArrow(lambda t: work(t), f"doc_id {kinds['doc_id']}, page {kinds['page']}, rect_no long, cluster long")


def line_styles(items: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, mostly_bold, font, x_bucket) of items with line_no: weight, main font, left edge in steps.

    The main font is that of most letters, of equal ones the first by name.
    """
    n = _chars(F.col("text"))
    order = Window.partitionBy("doc_id", "page", "line_no").orderBy("x", "item_no")
    seen = items.withColumn("_n", n).withColumn("_first", F.first("x").over(order))
    fonts = seen.groupBy("doc_id", "page", "line_no", "font").agg(
        F.sum(F.greatest("_n", F.lit(1))).alias("w"), F.sum(F.when(F.col("is_bold"), F.col("_n")).otherwise(0)).alias("bold"), F.sum("_n").alias("n"), F.first("_first").alias("_first")
    )
    top = F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("w"), "font")))[0]["font"]
    lines = fonts.groupBy("doc_id", "page", "line_no").agg(top.alias("font"), F.sum("bold").alias("bold"), F.sum("n").alias("n"), F.first("_first").alias("_first"))
    return lines.select("doc_id", "page", "line_no", ((F.col("n") > 0) & (F.col("bold") * 2 >= F.col("n"))).alias("mostly_bold"), "font", F.round(F.col("_first") / X_BUCKET).cast("int").alias("x_bucket"))


def body_style(items: DataFrame) -> DataFrame:
    """(doc_id, body_font, body_bucket): the font of most letters that are not bold, the left edge of most letters in lines not mostly bold."""
    plain = items.where(~F.col("is_bold")).groupBy("doc_id", "font").agg(F.sum(_chars(F.col("text"))).alias("w"))
    fonts = plain.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("w"), "font")))[0]["font"].alias("body_font"))
    lines = items.groupBy("doc_id", "page", "line_no").agg(F.sum(_chars(F.col("text"))).alias("w")).join(line_styles(items), ["doc_id", "page", "line_no"]).where(~F.col("mostly_bold"))
    edges = lines.groupBy("doc_id", "x_bucket").agg(F.sum("w").alias("w")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("w"), "x_bucket")))[0]["x_bucket"].alias("body_bucket"))
    return items.select("doc_id").distinct().join(fonts, "doc_id", "left").join(edges, "doc_id", "left")


def _cluster_sizes(values: Column, tolerance: float) -> Column:
    """How many of sorted values each cluster holds; a value joins while it is within tolerance of the running centre."""
    start = F.struct(F.lit(0.0).alias("centre"), F.array().cast("array<int>").alias("sizes"))

    def step(s: Column, v: Column) -> Column:
        last = F.get(s["sizes"], F.size(s["sizes"]) - 1)
        new = (F.size(s["sizes"]) == 0) | (F.abs(v - s["centre"]) > tolerance)
        grown = F.concat(F.slice(s["sizes"], F.lit(1), F.greatest(F.size(s["sizes"]) - 1, F.lit(0))), F.array(last + 1))
        return F.struct(F.when(new, v).otherwise((s["centre"] * last + v) / (last + 1)).alias("centre"), F.when(new, F.concat(s["sizes"], F.array(F.lit(1)))).otherwise(grown).alias("sizes"))

    return F.aggregate(values, start, step)["sizes"]


def cluster_counts(items: DataFrame) -> DataFrame:
    """(doc_id, page, rows, column_sizes): clusters of the heights of all items, and of the left edges of those with text."""
    got = items.groupBy("doc_id", "page").agg(
        F.array_sort(F.collect_list(F.col("y").cast("double"))).alias("ys"), F.array_sort(F.collect_list(F.when(L.utrim(F.col("text")) != "", F.col("x").cast("double")))).alias("xs")
    )
    return got.select("doc_id", "page", F.size(_cluster_sizes(F.col("ys"), Y_CLUSTER)).alias("rows"), _cluster_sizes(F.col("xs"), X_CLUSTER).alias("column_sizes"))


def row_boundaries(items: DataFrame) -> DataFrame:
    """(doc_id, page, row_ys): heights of rows from the top; a row ends where the next item is ROW_SHARE of the median size below its mean."""
    got = items.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.col("y").cast("double")), asc=False).alias("ys"), F.array_sort(F.collect_list(F.col("font_size").cast("double"))).alias("sizes"))
    far = F.greatest(F.get("sizes", F.floor(F.size("sizes") / 2).cast("int")) * ROW_SHARE, F.lit(LEAST_ROW_STEP))
    none = F.array().cast("array<struct<sum:double,n:int>>")

    def step(rows: Column, y: Column) -> Column:
        last = F.get(rows, F.size(rows) - 1)
        new = (F.size(rows) == 0) | (last["sum"] / last["n"] - y >= F.col("_far"))
        fresh = F.struct(y.alias("sum"), F.lit(1).alias("n"))
        grown = F.struct((last["sum"] + y).alias("sum"), (last["n"] + 1).alias("n"))
        return F.when(new, F.concat(rows, F.array(fresh))).otherwise(F.concat(F.slice(rows, F.lit(1), F.greatest(F.size(rows) - 1, F.lit(0))), F.array(grown)))

    return got.withColumn("_far", far).select("doc_id", "page", F.transform(F.aggregate("ys", none, step), lambda r: r["sum"] / r["n"]).alias("row_ys"))


def _nearest(values: Column, v: Column, most: Column) -> Column:
    """Place of the value nearest to v, the first of equals, if nearer than most."""
    best = F.array_min(F.transform(values, lambda x, k: F.struct(F.abs(v - x).alias("far"), k.alias("k"))))
    return F.when(best["far"] < most, best["k"])


def row_index(rows: Column, y: Column) -> Column:
    return _nearest(rows, y, F.lit(NEAREST_ROW))


def column_index(columns: Column, x: Column) -> Column:
    """Place of the column nearest to x, within half the least step between columns, held to COLUMN_NEAR."""
    step = F.array_min(F.zip_with(F.slice(columns, F.lit(2), F.greatest(F.size(columns) - 1, F.lit(0))), F.slice(columns, F.lit(1), F.greatest(F.size(columns) - 1, F.lit(0))), lambda b, a: F.abs(b - a)))
    near = F.when(F.size(columns) >= 2, F.greatest(F.lit(COLUMN_NEAR[0]), F.least(F.lit(COLUMN_NEAR[1]), step / 2))).otherwise(F.lit(COLUMN_NEAR[1]))
    return _nearest(columns, x, near)


def line_roles(items: DataFrame, roles: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, role, level) of items (with line_no, mcid) by roles (doc_id, page, mcid, role) of a structure tree.

    A line has the role of its first item that has one other than a container's. level is that of a heading role; a
    level that too many of a document's tagged lines have is no heading.
    """
    known = roles.where(~F.col("role").isin(CONTAINERS)).select("doc_id", "page", "mcid", "role")
    lines = items.where("mcid IS NOT NULL").join(known, ["doc_id", "page", "mcid"]).groupBy("doc_id", "page", "line_no").agg(F.min_by("role", F.struct("x", "item_no")).alias("role"))
    level = F.when(F.col("role") == "H", 1).when(F.col("role").rlike("^H[1-6]$"), F.substring("role", 2, 1).cast("int"))
    tagged = lines.withColumn("level", level)
    whole = tagged.groupBy("doc_id", "level").count().withColumn("_all", F.sum("count").over(Window.partitionBy("doc_id")))
    overused = whole.where(F.col("level").isNotNull() & (F.col("_all") >= LEAST_TAGGED) & (F.col("count") / F.col("_all") > MOST_OF_LEVEL)).select("doc_id", "level", F.lit(True).alias("_over"))
    return tagged.join(overused, ["doc_id", "level"], "left").select("doc_id", "page", "line_no", "role", F.when(F.col("_over").isNull(), F.col("level")).alias("level"))


def table_scores(cells: DataFrame, claims: DataFrame) -> DataFrame:
    """(doc_id, table_no, score, n_items) of full grids cells (doc_id, table_no, row, col, text) and the items they claim (doc_id, table_no, item_no)."""
    filled = F.col("text") != ""
    rows = cells.groupBy("doc_id", "table_no").agg(
        F.count("*").alias("cells"), F.sum(filled.cast("int")).alias("filled"), F.count_distinct(F.when(filled, F.col("row"))).alias("rows"), F.count_distinct(F.when(filled, F.col("col"))).alias("cols")
    )
    items = claims.groupBy("doc_id", "table_no").agg(F.count("*").alias("n_items"))
    score = F.col("n_items") * 100 + F.col("filled") * 25 + F.col("cols") * 60 + F.col("rows") * 20 - (F.col("cells") - F.col("filled")) * 4
    return rows.join(items, ["doc_id", "table_no"], "left").withColumn("n_items", F.coalesce("n_items", F.lit(0))).select("doc_id", "table_no", F.greatest(score, F.lit(0)).alias("score"), "n_items")


def selected_tables(scores: DataFrame, claims: DataFrame) -> DataFrame:
    """(doc_id, table_no): the tables kept, best score first, then most items, then first; none that shares an item with one kept."""
    own = claims.groupBy("doc_id", "table_no").agg(F.collect_set("item_no").alias("items"))
    kinds = dict(claims.dtypes)
    one = F.struct((-F.col("score")).alias("s"), (-F.col("n_items")).alias("n"), "table_no", F.coalesce("items", F.array().cast(f"array<{kinds['item_no']}>")).alias("items"))
    docs = scores.join(own, ["doc_id", "table_no"], "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    start = F.struct(F.array().cast(f"array<{kinds['item_no']}>").alias("claimed"), F.array().cast(f"array<{dict(scores.dtypes)['table_no']}>").alias("kept"))

    def step(s: Column, t: Column) -> Column:
        clash = F.size(F.array_intersect(s["claimed"], t["items"])) > 0
        return F.struct(F.when(clash, s["claimed"]).otherwise(F.concat(s["claimed"], t["items"])).alias("claimed"), F.when(clash, s["kept"]).otherwise(F.concat(s["kept"], F.array(t["table_no"]))).alias("kept"))

    return docs.select("doc_id", F.explode(F.aggregate("t", start, step)["kept"]).alias("table_no"))


def folio_candidates(items: DataFrame) -> DataFrame:
    """(doc_id, page, item_no, value): items of up to four digits in a page's upper or lower margin."""
    t = L.utrim(F.col("text"))
    margin = (F.col("y") > FOLIO_TOP) | (F.col("y") < FOLIO_BOTTOM)
    return items.where(t.rlike("^[0-9]{1,4}$") & margin).select("doc_id", "page", "item_no", t.cast("int").alias("value"))


def column_histogram(items: DataFrame, bin_width: float = 2.0, most_share: float = 0.6) -> DataFrame:
    """(doc_id, page, bin, n): how many items of a page stand over each step of its width; items wider than most_share do not count."""
    w = effective_width(F.struct("width", "text", "font_size"))
    seen = items.where(L.utrim(F.col("text")) != "").withColumn("_w", w)
    size = seen.groupBy("doc_id", "page").agg(F.min("x").alias("_left"), (F.max(F.col("x") + F.col("_w")) - F.min("x")).alias("_wide"))
    narrow = seen.join(size, ["doc_id", "page"]).where((F.col("_w") <= F.col("_wide") * most_share) & (F.col("_w") > 0))
    low = F.floor((F.col("x") - F.col("_left")) / bin_width).cast("int")
    high = F.ceil((F.col("x") + F.col("_w") - F.col("_left")) / bin_width).cast("int") - 1
    return narrow.select("doc_id", "page", F.explode(F.sequence(low, high)).alias("bin")).groupBy("doc_id", "page", "bin").agg(F.count("*").alias("n"))
