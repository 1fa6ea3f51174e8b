"""Operators on delimited text, cells and tables."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.functions import lines as L
from pagelathe.functions import text as X

# Candidates in the order in which a later one wins a tie.
DELIMITERS = [",", "\t", ";", "|"]
SNIFFED_LINES = 20


def sniff_delimiter(text: Column) -> Column:
    """The delimiter whose count is the same, and not 0, on most of the first lines; then with the higher median."""
    rows = F.filter(F.slice(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), 1, SNIFFED_LINES), lambda r: r != "")

    def score(place: int, mark: str) -> Column:
        counts = F.filter(F.transform(rows, lambda r: F.length(r) - F.length(F.replace(r, F.lit(mark), F.lit("")))), lambda n: n > 0)
        ordered = F.array_sort(counts)
        median = F.coalesce(F.get(ordered, F.floor(F.size(ordered) / 2).cast("int")), F.lit(0))
        alike = F.size(F.filter(counts, lambda n: n == median))
        return F.struct(alike.alias("alike"), median.alias("median"), F.lit(place).alias("place"), F.lit(mark).alias("mark"))

    return F.array_max(F.array(*[score(k, d) for k, d in enumerate(DELIMITERS)]))["mark"]


def header_rows(cells: DataFrame) -> DataFrame:
    """(doc_id, header_rows) of cells (doc_id, row, col, text): 1 unless there is one row or the first has typed cells."""
    kind = X.cell_kind(F.col("text"))
    first = F.bool_or((F.col("row") == 0) & kind.isin("number", "boolean"))
    return cells.groupBy("doc_id").agg(F.when((F.max("row") > 0) & ~first, 1).otherwise(0).alias("header_rows"))


def repeated(cells: DataFrame, budget: int) -> DataFrame:
    """(doc_id, row, col, text, error) of cells (doc_id, row, col, text, repeat): each cell as often as it says.

    A document that would have more cells than budget gives one row, with the error "limit" and no cell.
    """
    size = Window.partitionBy("doc_id")
    within = Window.partitionBy("doc_id", "row").orderBy("col")
    known = cells.withColumn("_n", F.sum("repeat").over(size)).withColumn("_from", F.sum("repeat").over(within) - F.col("repeat"))
    own = F.when((F.col("_n") <= budget) & (F.col("repeat") > 0), F.expr("transform(sequence(_from, _from + repeat - 1), x -> cast(x AS int))"))
    fine = known.where(F.col("_n") <= budget).select("doc_id", "row", F.explode(own).alias("col"), "text", F.lit(None).cast("string").alias("error"))
    over = cells.groupBy("doc_id").agg(F.sum("repeat").alias("_n")).where(F.col("_n") > budget)
    kinds = dict(cells.dtypes)
    return fine.union(over.select("doc_id", F.lit(None).cast(kinds["row"]), F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit("limit")))


def merge_warnings(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """(doc_id, r0, c0, r1, c1, warning) of the merges that reach beyond the grid, or whose document has none."""
    size = cells.groupBy("doc_id").agg(F.max("row").alias("_rows"), F.max("col").alias("_cols"))
    over = F.coalesce((F.col("r1") > F.col("_rows")) | (F.col("c1") > F.col("_cols")), F.lit(True))
    return merges.join(size, "doc_id", "left").where(over).select("doc_id", "r0", "c0", "r1", "c1", F.lit("merged range outside the grid").alias("warning"))


def merged_cells(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """cells with slot, row_span, col_span, origin_row, origin_col, from merges (doc_id, r0, c0, r1, c1) within the grid."""
    size = cells.groupBy("doc_id").agg(F.max("row").alias("_rows"), F.max("col").alias("_cols"))
    fine = merges.join(size, "doc_id").where((F.col("r1") <= F.col("_rows")) & (F.col("c1") <= F.col("_cols"))).select(F.col("doc_id").alias("_d"), "r0", "c0", "r1", "c1")
    inside = (F.col("doc_id") == F.col("_d")) & F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))
    got = cells.join(fine, inside, "left")
    origin = F.col("r0").isNull() | ((F.col("row") == F.col("r0")) & (F.col("col") == F.col("c0")))
    return got.select(
        *cells.columns,
        F.when(origin, "origin").otherwise("covered").alias("slot"),
        F.when(origin, F.coalesce(F.col("r1") - F.col("r0") + 1, F.lit(1))).cast("int").alias("row_span"),
        F.when(origin, F.coalesce(F.col("c1") - F.col("c0") + 1, F.lit(1))).cast("int").alias("col_span"),
        F.coalesce("r0", "row").alias("origin_row"),
        F.coalesce("c0", "col").alias("origin_col"),
    )


def markdown_tables(cells: DataFrame, header: int = 1) -> DataFrame:
    """(doc_id, markdown) of cells (doc_id, row, col, text): a pipe table, with an empty header where header is 0."""
    rows = cells.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", X.escape_cell(F.coalesce("text", F.lit(""))).alias("t")))).alias("c"))
    lined = rows.select("doc_id", "row", F.size("c").alias("n"), F.concat(F.lit("| "), F.array_join(F.transform("c", lambda x: x["t"]), " | "), F.lit(" |")).alias("line"))
    whole = lined.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("l"), F.max("n").alias("n"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("n")))
    blank = F.concat(F.lit("|"), F.repeat(F.lit("  |"), F.col("n")))
    text = F.transform("l", lambda x: x["line"])
    top = F.slice(text, 1, header) if header else F.array(blank)
    rest = F.slice(text, F.lit(header + 1), F.greatest(F.size(text) - header, F.lit(0)))
    return whole.select("doc_id", F.array_join(F.concat(top, F.array(rule), rest), "\n").alias("markdown"))


def html_tables(cells: DataFrame, header: int = 1) -> DataFrame:
    """(doc_id, html) of cells with spans, as from merged_cells(); covered cells leave no element."""
    tag = F.when(F.col("row") < header, "th").otherwise("td")
    span = lambda name, c: F.when(F.col(c) > 1, F.concat(F.lit(f' {name}="'), F.col(c).cast("string"), F.lit('"'))).otherwise("")
    cell = F.concat(F.lit("<"), tag, span("rowspan", "row_span"), span("colspan", "col_span"), F.lit(">"), X.escape_html(F.coalesce("text", F.lit(""))), F.lit("</"), tag, F.lit(">"))
    rows = cells.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.when(F.col("slot") == "origin", F.struct("col", cell.alias("t"))))).alias("c"))
    lined = rows.select("doc_id", "row", F.concat(F.lit("<tr>"), F.array_join(F.transform("c", lambda x: x["t"]), ""), F.lit("</tr>")).alias("line"))
    whole = lined.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("l"))
    return whole.select("doc_id", F.concat(F.lit("<table>"), F.array_join(F.transform("l", lambda x: x["line"]), ""), F.lit("</table>")).alias("html"))


def table_checks(cells: DataFrame, is_data, small_font: bool = False) -> DataFrame:
    """(doc_id, rows, cols, data_share, consistent, key_value, table_like): what tells a table from chance alignment.

    cells is a full grid (doc_id, row, col, text); is_data is the predicate of a cell that holds data. data_share and
    table_like leave the first row out.
    """
    text = F.coalesce("text", F.lit(""))
    filled, visible = text != "", L.utrim(text) != ""
    n = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0)))
    first, body = L.utrim(text), F.col("row") > 0
    label = (F.col("col") == 0) & (first.endswith(":") | ((F.octet_length(first) > 3) & first.rlike(r"^[\p{Lu}\s\p{Z}()]+$")))
    rows = cells.groupBy("doc_id", "row").agg(
        n(filled).alias("f"), n(visible & body).alias("v"), n(visible & body & is_data(text)).alias("d"), F.max(F.col("col") + 1).alias("c"), n(label).alias("label"), n(F.when(visible & body, F.octet_length(first))).alias("bytes")
    )
    modes = rows.groupBy("doc_id", "f").count().groupBy("doc_id").agg(F.max_by("f", F.struct("count", "f")).alias("mode"))
    cols = rows.groupBy("doc_id").agg(F.max("c").alias("cols"))
    tolerance = F.when(F.col("cols") > 15, F.floor(F.col("cols") / 4)).otherwise(2)
    near = (F.col("f") - F.col("mode")).between(-tolerance, tolerance)
    got = (
        rows.join(modes, "doc_id")
        .join(cols, "doc_id")
        .groupBy("doc_id")
        .agg(
            F.count("*").alias("rows"), F.first("cols").alias("cols"), (F.sum("d") / F.sum("v")).alias("data_share"),
            (n(near) / F.count("*")).alias("_near"), F.sum("v").alias("_v"), F.sum("bytes").alias("_bytes"),
            ((n(F.col("f") <= 2) > F.count("*") * 0.7) & (F.sum("label") > F.count("*") * 0.5) & (F.first("cols") <= 6)).alias("key_value"),
        )
    )
    consistent = (F.col("rows") < 3) | (F.col("_near") > F.when(F.col("cols") > 15, 0.25).otherwise(0.40))
    short = F.lit(False) if small_font else (F.col("cols") == 2) & (F.floor(F.col("_bytes") / F.col("_v")) <= 25)
    like = (F.col("_v") > 0) & ((F.col("data_share") > (0.2 if small_font else 0.3)) | (F.col("cols") >= 3) | short)
    return got.select("doc_id", "rows", "cols", "data_share", consistent.alias("consistent"), "key_value", F.coalesce(like, F.lit(False)).alias("table_like"))


def continuation_runs(tables: DataFrame) -> DataFrame:
    """(doc_id, run, first_page, last_page, cols, rows) of tables (doc_id, page, cols, rows): adjacent pages, equal columns.

    From the second page of a run on, two rows, the repeated header and its rule, do not count.
    """
    order = Window.partitionBy("doc_id").orderBy("page")
    goes_on = (F.col("page") == F.lag("page").over(order) + 1) & (F.col("cols") == F.lag("cols").over(order))
    runs = tables.withColumn("_new", F.coalesce((~goes_on).cast("int"), F.lit(1))).withColumn("run", F.sum("_new").over(order))
    own = F.when(F.col("_new") == 1, F.col("rows")).otherwise(F.greatest(F.col("rows") - 2, F.lit(0)))
    return runs.groupBy("doc_id", "run").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.first("cols").alias("cols"), F.sum(own).alias("rows"))


_OTSL = re.compile(r"<(nl|fcel|ecel|lcel|ucel|xcel)>")


def otsl_to_html(source: str | None) -> str:
    """An HTML table of table-structure tokens; a complete table passes through, text without tokens gives an empty one.

    lcel widens the cell to its left, ucel lengthens the cell above, xcel does both to the larger of the two.
    A token without such a cell is an empty cell.
    """
    source = (source or "").strip()
    if source.lower().startswith("<table") and source.lower().endswith("</table>"):
        return source
    parts = _OTSL.split(source)
    owner: dict[tuple[int, int], int] = {}
    cells: list[list] = []  # text, row, col, last row, last col
    row = col = 0
    for tag, after in zip(parts[1::2], parts[2::2], strict=True):
        if tag == "nl":
            row, col = row + 1, 0
            continue
        near = {"lcel": [(row, col - 1)], "ucel": [(row - 1, col)], "xcel": [(row, col - 1), (row - 1, col)]}.get(tag, [])
        found = [owner[p] for p in near if p in owner]
        if found:
            k = max(found, key=lambda i: (cells[i][3] - cells[i][1] + 1) * (cells[i][4] - cells[i][2] + 1))
            cells[k][3], cells[k][4] = max(cells[k][3], row), max(cells[k][4], col)
        else:
            k = len(cells)
            cells.append([after.strip() if tag == "fcel" else "", row, col, row, col])
        owner[row, col] = k
        col += 1
    lines: dict[int, list[str]] = {}
    for text, r, c, last_r, last_c in cells:
        spans = (f' rowspan="{last_r - r + 1}"' if last_r > r else "") + (f' colspan="{last_c - c + 1}"' if last_c > c else "")
        lines.setdefault(r, []).append(f"<td{spans}>{html.escape(text, quote=False)}</td>")
    return "<table>" + "".join(f"<tr>{''.join(lines.get(r, []))}</tr>" for r in range(max((c[3] for c in cells), default=-1) + 1)) + "</table>"


def otsl_html(source: Column) -> Column:
    """otsl_to_html() of a column, in Arrow batches."""
    return F.pandas_udf(_otsl_series, "string")(source)


def _otsl_series(source: pd.Series) -> pd.Series:
    return source.map(otsl_to_html)
