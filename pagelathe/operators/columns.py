"""Columns of pages and the order in which their lines are read.

Where the columns of a page lie is worked out per page in numpy, since it needs the whole page's profile; grouping and
ordering the lines are expressions and windows keyed by document, page and column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.functions import lines as L
from pagelathe.lineage import cut
from pagelathe.operators import items as I
from pagelathe.operators.layout import effective_width

# Fixed values, in points and shares.
BIN, LEAST_GUTTER, NOISE, WIDE, MARGIN = 2.0, 8.0, 0.15, 0.6, 0.05
LEAST_PAGE, LEAST_ITEMS, LEAST_SIDE, LEAST_SMALL_SIDE, LEAST_OVERLAP, MOST_GUTTERS = 200.0, 20, 10, 3, 0.30, 3
DENSE_ITEMS, PEAK_WINDOW, LEAST_PEAK, PEAK_BALANCE, CONTRAST = 100, 25, 20.0, 0.40, 0.60
CUT_GAP, CUT_MARGIN, CUT_OVERLAP = 15.0, 0.10, 0.20
PROSE_FILL, PROSE_SHARE, PROSE_LINES, PROSE_WIDTH, PROSE_ITEMS = 0.45, 0.40, 8, 120.0, 3.5
SPAN_SHARE, SPAN_TOLERANCE, GUTTER_TOLERANCE, SPAN_GAP, TOUCH_SHARE, TOUCH = 1.3, 5.0, 15.0, 5.0, 0.10, 20.0
LIST_MARKERS, MARKER_SHARE = "•●○◦▪▫◆◇■□", 0.8
NEWS_LINES, NEWS_BALANCE, SIDEBAR_LINES, COLLISION = 15, 0.7, 5, 5.0
STRAGGLER_GAPS, LEAST_STRAGGLER_GAP, TOP_MARGIN, SAME_ROW = 3.0, 30.0, 5.0, 3.0


def _overlap(y: np.ndarray, left: np.ndarray, right: np.ndarray) -> float:
    return max(0.0, min(y[left].max(), y[right].max()) - max(y[left].min(), y[right].min()))


def _checked(runs: list[tuple[int, int]], x: np.ndarray, w: np.ndarray, y: np.ndarray, marker: np.ndarray, by_centre: bool) -> list[float]:
    """Edges of the columns that gutters, as ranges of bins, leave, if both sides hold enough at the same heights."""
    low, high = x.min(), (x + w).max()
    narrow = y[w <= (high - low) * WIDE]
    extent = np.ptp(narrow) if len(narrow) else 0.0
    kept = []
    for a, b in runs:
        gutter = low + (a + b) / 2 * BIN
        left = x + w / 2 <= gutter if by_centre else x + w <= gutter
        right = ~left if by_centre else x >= gutter
        counts = sorted((int(left.sum()), int(right.sum())))
        if counts[1] < LEAST_SIDE or counts[0] < LEAST_SMALL_SIDE:
            continue
        small = left if left.sum() <= right.sum() else right
        if marker[small].mean() >= MARKER_SHARE or (extent > 0 and _overlap(y, left, right) / extent < LEAST_OVERLAP):
            continue
        kept.append(((b - a) * counts[0], a, gutter))
    best = sorted(sorted(kept, key=lambda k: -k[0])[:MOST_GUTTERS], key=lambda k: k[1])
    return [low, *(g for _, _, g in best), high]


def _quiet_runs(quiet: np.ndarray) -> list[tuple[int, int]]:
    turns = np.flatnonzero(np.diff(np.concatenate([[False], quiet, [False]]).astype(np.int8)))
    return list(zip(turns[0::2].tolist(), turns[1::2].tolist(), strict=True))


def _deepest_dip(profile: np.ndarray, width: float) -> list[tuple[int, int]]:
    """The clearest dip between two high stretches of a smoothed profile, as one narrow gutter."""
    n = len(profile)
    sums = np.concatenate([[0], np.cumsum(profile)])
    smooth = np.array([(sums[min(k + 3, n)] - sums[max(k - 2, 0)]) / (min(k + 3, n) - max(k - 2, 0)) for k in range(n)])
    best: tuple[float, int] | None = None
    for k in range(PEAK_WINDOW, n - PEAK_WINDOW) if n >= 10 else ():
        here = smooth[k]
        if here < 1 or (smooth[max(k - 3, 0) : k + 4] < here - 0.5).any():
            continue
        peaks = sorted((smooth[k - PEAK_WINDOW : k].max(), smooth[k + 1 : k + 1 + PEAK_WINDOW].max()))
        inside = width * MARGIN < k * BIN < width * (1 - MARGIN)
        if peaks[0] < LEAST_PEAK or peaks[0] / peaks[1] < PEAK_BALANCE or here / peaks[0] >= CONTRAST or not inside:
            continue
        if best is None or here / peaks[0] < best[0]:
            best = (here / peaks[0], k)
    return [(max(0, best[1] - 2), min(best[1] + 3, n))] if best else []


def _widest_gap(x: np.ndarray, w: np.ndarray, y: np.ndarray) -> list[float] | None:
    """Two columns on either side of the widest strip that no item touches."""
    low, high = x.min(), (x + w).max()
    order = np.argsort(x, kind="stable")
    reach = np.maximum.accumulate((x + w)[order])[:-1]
    gaps = x[order][1:] - reach
    if not len(gaps) or gaps.max() < CUT_GAP:
        return None
    k = int(np.argmax(gaps))
    split = (reach[k] + x[order][k + 1]) / 2
    if min(split - low, high - split) < (high - low) * CUT_MARGIN:
        return None
    left = x + w / 2 <= split
    counts = sorted((int(left.sum()), int((~left).sum())))
    if counts[1] < LEAST_SIDE or counts[0] < LEAST_SMALL_SIDE or _overlap(y, left, ~left) / max(np.ptp(y), 1.0) < CUT_OVERLAP:
        return None
    return [low, float(split), high]


def _rows(y: np.ndarray, tolerance: float) -> list[np.ndarray]:
    """Items in rows from the top; a row holds what is within tolerance of its first item."""
    out: list[list[int]] = []
    for k in np.argsort(-y, kind="stable").tolist():
        if out and abs(y[out[-1][0]] - y[k]) < tolerance:
            out[-1].append(k)
        else:
            out.append([k])
    return [np.array(r) for r in out]


def _all_prose(edges: list[float], x: np.ndarray, w: np.ndarray, y: np.ndarray) -> bool:
    centre = x + w / 2
    for low, high in zip(edges, edges[1:], strict=False):
        own = np.flatnonzero((centre >= low) & (centre <= high))
        if high - low < PROSE_WIDTH or len(own) < PROSE_LINES:
            return False
        rows = _rows(y[own], SAME_ROW)
        full = sum(max(0.0, np.minimum((x + w)[own[r]], high).max() - np.maximum(x[own[r]], low).min()) >= (high - low) * PROSE_FILL for r in rows)
        if len(rows) < PROSE_LINES or full / len(rows) < PROSE_SHARE or len(own) / len(rows) > PROSE_ITEMS:
            return False
    return True


def column_edges(x: np.ndarray, w: np.ndarray, y: np.ndarray, marker: np.ndarray) -> list[float]:
    """The left edge of the first column, what parts the columns, and the right edge of the last.

    Gutters are runs of the page's width over which hardly any item stands; failing those, on dense pages, a clear dip
    between columns of prose; else the widest empty strip. marker tells items that are list marks alone.
    """
    low, high = float(x.min()), float((x + w).max())
    one = [low, high]
    if len(x) < LEAST_ITEMS or high - low < LEAST_PAGE:
        return one
    bins = max(1, int(np.ceil((high - low) / BIN)))
    narrow = w <= (high - low) * WIDE
    start, stop = (np.clip(f((v - low) / BIN).astype(np.int64), 0, bins)[narrow] for f, v in ((np.floor, x), (np.ceil, x + w)))
    profile = np.cumsum(np.bincount(start, minlength=bins + 1) - np.bincount(stop, minlength=bins + 1))[:bins]
    edge = (high - low) * MARGIN
    runs = [(a, b) for a, b in _quiet_runs(profile <= int(profile.max() * NOISE)) if (b - a) * BIN >= LEAST_GUTTER and edge < (a + b) / 2 * BIN < high - low - edge]
    if runs:
        for by_centre in (True, False):
            if len(found := _checked(runs, x, w, y, marker, by_centre)) > 2:
                return found
    elif len(x) >= DENSE_ITEMS:
        found = _checked(_deepest_dip(profile, high - low), x, w, y, marker, True)
        if len(found) > 2 and _all_prose(found, x, w, y):
            return found
    return _widest_gap(x, w, y) or one


def column_of_items(edges: list[float], x: np.ndarray, w: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The column of each item, that of the widest overlap; -1 for what runs across columns, alone or with its row."""
    low, high = np.array(edges[:-1]), np.array(edges[1:])
    right = x + w
    overlap = np.maximum(0.0, np.minimum(right[:, None], high) - np.maximum(x[:, None], low))
    across = ((overlap > (high - low) * TOUCH_SHARE) | (overlap > TOUCH)).sum(1) >= 2
    gutters = np.array(edges[1:-1])
    for row in _rows(y, SPAN_TOLERANCE) if len(x) >= 3 else []:
        row = row[np.argsort(x[row], kind="stable")]
        if len(row) < 2 or right[row[-1]] - x[row[0]] <= (high - low).max() * SPAN_SHARE:
            continue
        ends, starts = right[row[:-1]], x[row[1:]]
        apart = (starts - ends >= SPAN_GAP)[:, None] & (gutters > ends[:, None] - GUTTER_TOLERANCE) & (gutters < starts[:, None] + GUTTER_TOLERANCE)
        if not apart.any():
            across[row] = True
    return np.where(across, -1, overlap.argmax(1))


def page_columns(items: DataFrame) -> DataFrame:
    """(doc_id, page, item_no, col, cols, col_width): the column of each item with text, -1 across columns, and how many there are.

    Numbers in the upper and lower margin take no part in finding columns. A page is one group.
    """

    def work(page: pa.Table) -> pa.Table:
        page = page.sort_by("item_no")
        x, w, y = (page.column(c).to_numpy().astype(np.float64) for c in ("x", "w", "y"))
        marker, folio = (page.column(c).to_numpy(zero_copy_only=False) for c in ("marker", "folio"))
        body = ~folio if (~folio).any() else np.ones(len(x), np.bool_)
        edges = column_edges(x[body], w[body], y[body], marker[body])
        col = column_of_items(edges, x, w, y) if len(edges) > 2 else np.zeros(len(x), np.int64)
        width = np.where(col >= 0, np.diff(edges)[np.maximum(col, 0)], np.nan)
        out = page.select(["doc_id", "page", "item_no"])
        return out.append_column("col", pa.array(col, pa.int32())).append_column("cols", pa.array(np.full(len(x), len(edges) - 1), pa.int32())).append_column("col_width", pa.array(width, pa.float64()))

    kinds = dict(items.dtypes)
    t = L.utrim(F.col("text"))
    folio = t.rlike("^[0-9]{1,4}$") & ((F.col("y") > I.FOLIO_TOP) | (F.col("y") < I.FOLIO_BOTTOM))
    slim = items.where(t != "").select(
        "doc_id", "page", "item_no", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), effective_width(F.struct("width", "text", "font_size")).cast("double").alias("w"), t.rlike(f"^[{LIST_MARKERS}]$").alias("marker"), folio.alias("folio")
    )
    return slim.groupBy("doc_id", "page").applyInArrow(lambda p: work(p), ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", "page", "item_no")) + ", col int, cols int, col_width double")


def _newspaper(columns: Column) -> Column:
    """Whether columns, structs (n, col, ys, width) with heights in order, are read one after the other, not row by row."""
    n = F.transform(columns, lambda c: c["n"])
    least, most = F.array_min(n), F.array_max(n)
    small = F.array_min(columns)
    meets = F.filter(small["ys"], lambda y: F.exists(columns, lambda c: (c["col"] != small["col"]) & F.exists(c["ys"], lambda o: F.abs(o - y) < COLLISION)))
    dense = (least >= NEWS_LINES) & ((least / most > NEWS_BALANCE) | (F.size(meets) / F.size(small["ys"]) > 0.5))
    width = F.transform(columns, lambda c: c["width"])
    narrow = F.array_min(F.transform(columns, lambda c: F.struct(c["width"], c["col"], c["n"], c["ys"])))
    wide = F.array_max(F.transform(columns, lambda c: F.struct(c["width"], c["col"], c["n"], c["ys"])))
    gap = lambda c: (F.element_at(c["ys"], -1) - c["ys"][0]) / (c["n"] - 1)
    sidebar = (
        (F.size(columns) == 2) & (least >= SIDEBAR_LINES) & (least < NEWS_LINES) & (F.array_min(width) / F.array_max(width) < 0.50) & (least / most < 0.35) & (most >= 20) & (F.array_min(width) >= 160)
        & (narrow["n"] == least) & (gap(wide) > 0) & (gap(narrow) / gap(wide) >= 2.5)
    )
    return (F.size(columns) >= 2) & (dense | sidebar)


def reading_lines(items: DataFrame) -> DataFrame:
    """(doc_id, page, item_no, line_no, line_y): items with text in lines, and lines in reading order.

    Columns of newspapers are read one after the other: first what stands above them, then each column's main run of lines,
    then what is left of the columns, last what runs across further down. In other pages the lines of all columns
    are read by height, and those of one height are one line.
    """
    key = ["doc_id", "page"]
    placed = items.where(L.utrim(F.col("text")) != "").join(page_columns(items), [*key, "item_no"])
    placed = cut(placed)
    grouped = cut(I.grouped_lines(placed, (*key, "col")))
    joined = grouped.join(placed.select(*key, "item_no", "x", "cols", "col_width"), [*key, "item_no"])
    lines = joined.groupBy(*key, "col", "line_no").agg(F.first("line_y").alias("y"), F.min("x").alias("x"), F.first("col_width").alias("w"))
    column = lines.where("col >= 0").groupBy(*key, "col").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("y")).alias("ys"), F.first("w").alias("width"))
    pages = column.groupBy(*key).agg(_newspaper(F.collect_list(F.struct("n", "col", "ys", "width"))).alias("news"))
    down = Window.partitionBy(*key, "col").orderBy("line_no")
    whole = Window.partitionBy(*key, "col")
    gapped = lines.withColumn("_gap", F.lag("y").over(down) - F.col("y")).withColumn("_gaps", F.array_sort(F.collect_list("_gap").over(whole)))
    far = F.greatest(F.get("_gaps", F.floor(F.size("_gaps") / 2).cast("int")) * STRAGGLER_GAPS, F.lit(LEAST_STRAGGLER_GAP))
    parted = gapped.withColumn("_part", F.when((F.size("_gaps") >= 2) & (F.col("col") >= 0), F.sum(F.coalesce((F.col("_gap") > far).cast("int"), F.lit(0))).over(down)).otherwise(0))
    sized = parted.withColumn("_n", F.count("*").over(Window.partitionBy(*key, "col", "_part")))
    core = sized.withColumn("_core", (F.col("col") >= 0) & (F.col("_part") == F.max_by("_part", F.struct("_n", "_part")).over(whole)))
    tops = core.where("_core").groupBy(*key, "col").agg(F.max("y").alias("t")).groupBy(*key).agg(F.min("t").alias("_top"))
    known = core.join(pages, key, "left").join(tops, key, "left")
    above = F.col("y") > F.col("_top") + TOP_MARGIN
    zone = F.when(F.col("_core"), 1).when(above, 0).when(F.col("col") >= 0, 2).otherwise(3)
    by_height = ~F.coalesce("news", F.lit(False))
    ranked = known.withColumn("_zone", F.when(by_height, 0).otherwise(zone)).withColumn("_flow", F.col("_zone").isin(1, 2))
    order = F.struct("_zone", F.when(F.col("_flow"), F.col("col")).otherwise(0).alias("a"), F.when(F.col("_flow"), F.col("line_no")).otherwise(0).alias("b"), F.when(F.col("_flow"), 0.0).otherwise(-F.col("y")).alias("c"), F.col("x").alias("d"), F.col("col").alias("e"), F.col("line_no").alias("f"))
    listed = ranked.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "col", "line_no", "y", by_height.alias("merge")))).alias("l"), F.max("col").alias("_most"))
    start = F.struct(F.lit(-1).alias("no"), F.lit(0.0).alias("y"), F.array().cast("array<struct<col:int,part:int,no:int,y:double>>").alias("out"))

    def step(s: Column, i: Column) -> Column:
        same = (s["no"] >= 0) & i["merge"] & (F.abs(s["y"] - i["y"]) < SAME_ROW)
        no, y = F.when(same, s["no"]).otherwise(s["no"] + 1), F.when(same, s["y"]).otherwise(i["y"])
        return F.struct(no.alias("no"), y.alias("y"), F.concat(s["out"], F.array(F.struct(i["col"].alias("col"), i["line_no"].alias("part"), no.alias("no"), y.alias("y")))).alias("out"))

    # a page of one column keeps its lines as they were grouped
    plain = F.transform("l", lambda i: F.struct(i["col"].alias("col"), i["line_no"].alias("part"), i["line_no"].alias("no"), i["y"].alias("y")))
    single = (F.col("_most") == 0) & F.forall("l", lambda i: i["col"] == 0)
    numbered = listed.select(*key, F.inline(F.when(single, plain).otherwise(F.aggregate("l", start, step)["out"])))
    return grouped.select(*key, "item_no", "col", F.col("line_no").alias("part")).join(numbered, [*key, "col", "part"]).select(*key, "item_no", F.col("no").alias("line_no"), F.col("y").alias("line_y"))
