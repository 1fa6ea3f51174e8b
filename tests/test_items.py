"""Literal cases of the operators on text items, texts and calls; what they should give is written out by hand."""

import json

import numpy as np
import pytest
from pagelathe import api, transport
from pagelathe.__main__ import main, pages_of
from pagelathe.functions import lines as L
from pagelathe.functions import quality as Q
from pagelathe.functions import text as X
from pagelathe.operators import columns as C
from pagelathe.operators import evidence as E
from pagelathe.operators import items as I
from pagelathe.operators import layout as P
from pagelathe.operators import pdf_markdown as M
from pagelathe.operators import render as R
from pagelathe.operators import tables as T
from pyspark.sql import functions as F

SCHEMA = "doc_id long, page int, line_no int, item_no long, text string, x double, y double, width double, height double, font_size double, font string, is_bold boolean, is_italic boolean, is_underline boolean"


def items(spark, rows):
    """rows of (text, x, y, width, {more}) on one page."""
    full = []
    for k, (text, x, y, width, *more) in enumerate(rows):
        o = {"font_size": 10.0, "font": "Times", "bold": False, "italic": False, "under": False, "line": 0} | (more[0] if more else {})
        full.append((1, 1, o["line"], k, text, float(x), float(y), float(width), 10.0, float(o["font_size"]), o["font"], o["bold"], o["italic"], o["under"]))
    return spark.createDataFrame(full, SCHEMA)


JOINS = [
    ("tail ", 0, 30, "x", 30, 0.1, "Times", False), ("www", 0, 30, ".com", 60, 0.1, "Times", True), ("Key:", 0, 30, "Value", 30, 0.1, "Times", False), ("34,20", 0, 25, "8", 27, 0.1, "Times", True), ("34,20", 0, 25, "8", 29, 0.1, "Times", False),
    ("b", 0, 5, "illion", 6.9, 0.1, "Times", True), ("b", 0, 5, "illion", 7.1, 0.1, "Times", False), ("a", 0, 5, "b", 5.9, 0.1, "Times", True), ("a", 0, 5, "b", 6.1, 0.1, "Times", False), ("enterta", 0, 30, "inment", 31.7, 0.1, "Times", True),
    ("LCOE", 0, 30, "WITH", 31.7, 0.1, "Times", False), ("word", 0, 30, "next", 30.05, 0.1, "C2_0", False), ("three words here", 0, 30, "next", 30.05, 0.1, "C2_0", True), ("left", 0, 30, "far", 61, 0.1, "Times", False), ("wide", 0, 30, "back", 15, 0.1, "Times", False),
    ("q", 0, 6, "r", 13.4, 0.9, "Times", True), ("q", 0, 6, "r", 13.6, 0.9, "Times", False), ("ilw", 0, 12, "m", 16.9, 0.9, "Times", True), ("ab", 0, 12, "cd", 20.9, 0.9, "Times", True), ("CONST", 0, 0, "ANCIA", 26, 0.1, "Times", True),
    ("presente", 0, 0, "CONS", 36, 0.1, "Times", False), ("世", 0, 10, "界", 10.9, 0.1, "Times", True), ("世", 0, 0, "界", 5, 0.1, "Times", True), ("+", 0, 5, "3", 7, 0.1, "Times", True),
]


def test_joins(spark):
    rows = [(k, a, float(x), float(w), b, float(y), t, f, want) for k, (a, x, w, b, y, t, f, want) in enumerate(JOINS)]
    df = spark.createDataFrame(rows, "k int, a string, ax double, aw double, b string, bx double, t double, f string, want boolean")
    one = lambda t, x, w: F.struct(F.col(t).alias("text"), F.col(x).alias("x"), w.alias("width"), F.lit(10.0).alias("font_size"), F.col("f").alias("font"))
    got = df.withColumn("got", I.joins(one("a", "ax", F.col("aw")), one("b", "bx", F.lit(20.0)), F.col("t"))).where("got IS DISTINCT FROM want").collect()
    assert got == []


def texts(spark, rows, threshold=0.1):
    got = I.line_texts(items(spark, rows).withColumn("threshold", F.lit(threshold))).collect()
    return [(r["text"], r["marked"]) for r in sorted(got, key=lambda r: r["line_no"])]


def test_line_texts(spark):
    bold, italic, under = {"bold": True}, {"italic": True}, {"under": True}
    assert texts(spark, [("Hello", 0, 0, 25), ("bold", 30, 0, 20, bold), ("world", 52, 0, 25, bold), ("end", 90, 0, 15)]) == [("Hello bold world end", "Hello **bold world** end")]
    assert texts(spark, [("a", 0, 0, 5), ("under", 10, 0, 20, {"bold": True, "under": True}), ("it", 40, 0, 10, italic)]) == [("a under it", "a <u>under</u> *it*")]
    assert texts(spark, [("well", 0, 0, 20), ("-", 25, 0, 3), ("known", 32, 0, 25)]) == [("well-known", "well-known")]
    assert texts(spark, [("H", 0, 0, 7), ("2", 8, -3, 4, {"font_size": 6}), ("O", 13, 0, 7)]) == [("H2O", "H2O")]
    assert texts(spark, [("x", 0, 0, 5, under), (" led", 6, 0, 20, under)]) == [("x led", "<u>x led</u>")]
    assert texts(spark, [("עולם", 0, 0, 20), ("שלום", 30, 0, 20)]) == [("שלום עולם", "שלום עולם")]


def test_letter_spacing(spark):
    wide = [("w o r d", k * 60, 0, 40) for k in range(12)]
    (r,) = I.letter_spacing(items(spark, wide)).collect()
    assert (r["threshold"], r["spaced"]) == (2.0, True)
    assert {x["text"] for x in I.unspaced(items(spark, wide), I.letter_spacing(items(spark, wide))).collect()} == {"word"}
    (r,) = I.letter_spacing(items(spark, [("plain", k * 60, 0, 57) for k in range(12)])).collect()
    assert (r["threshold"], r["spaced"]) == (0.1, False)
    (r,) = I.letter_spacing(items(spark, [("a", k * 11, 0, 5) for k in range(12)])).collect()
    assert r["threshold"] == pytest.approx(0.93) and not r["spaced"]


def lines(spark, rows):
    return [r["line_no"] for r in sorted(I.grouped_lines(items(spark, rows)).collect(), key=lambda r: r["item_no"])]


def test_grouped_lines(spark):
    assert lines(spark, [("a", 0, 700, 5), ("b", 10, 701, 5), ("c", 0, 690, 5)]) == [0, 0, 1]
    assert lines(spark, [("a", 0, 700, 5), ("b", 3, 698, 5)]) == [0, 1]
    assert lines(spark, [("a", 0, 700, 5), ("b", 40, 700, 5), ("c", 20, 698, 5)]) == [0, 0, 1]
    prose = "goes on with many more words of text"
    assert lines(spark, [("Some heading words", 0, 700, 80), (prose, 200, 700, 150)]) == [0, 1]
    assert lines(spark, [("Some heading words", 0, 700, 80), (prose.capitalize(), 200, 700, 150)]) == [0, 0]
    assert lines(spark, [("Some heading words", 0, 700, 80, {"bold": True}), (prose.capitalize(), 200, 700, 150)]) == [0, 1]
    jumping = [(str(k), 0, 700 if k % 2 else 100 - k, 5) for k in range(8)]
    assert lines(spark, jumping) == [4, 0, 5, 0, 6, 0, 7, 0] or len(set(lines(spark, jumping))) >= 5


def test_small_page_operators(spark):
    rects = spark.createDataFrame([(1, 1, k, float(x), float(y), 10.0, 10.0) for k, (x, y) in enumerate([(0, 0), (12, 0), (24, 0), (100, 100), (200, 0), (212, 0)])], "doc_id long, page int, rect_no long, x double, y double, width double, height double")
    assert {r["rect_no"]: r["cluster"] for r in I.rect_clusters(rects, 1.5, 2).collect()} == {0: 0, 1: 0, 2: 0, 4: 4, 5: 4}
    four = items(spark, [("a", 0, 100, 5), ("b", 50, 98, 5), ("c", 0, 80, 5), ("d", 60, 79, 5)])
    (r,) = I.row_boundaries(four).collect()
    assert r["row_ys"] == [99.0, 79.5]
    (r,) = I.cluster_counts(four).collect()
    assert (r["rows"], r["column_sizes"]) == (2, [2, 1, 1])
    columns = F.array(F.lit(0.0), F.lit(100.0))
    got = spark.range(1).select(I.column_index(columns, F.lit(40.0)), I.column_index(columns, F.lit(151.0)), I.row_index(columns, F.lit(86.0)), I.row_index(columns, F.lit(84.0))).first()
    assert tuple(got) == (0, None, 1, None)
    styles = I.line_styles(items(spark, [("4.", 30, 0, 5), ("Bold title", 40, 0, 50, {"bold": True, "font": "B"})])).first()
    assert (styles["mostly_bold"], styles["font"], styles["x_bucket"]) == (True, "B", 1)
    turned, _ = I.turned(items(spark, [("ab", 10, 20, 0), ("c", 1, 2, 9)]).withColumn("rotated", F.lit(True)), rects.limit(0))
    assert sorted((r["x"], r["y"], r["width"]) for r in turned.collect()) == [(2.0, -1.0, 9.0), (20.0, -10.0, 10.0)]


def test_tiers_and_regions(spark):
    base = spark.createDataFrame([(1, 10.0), (2, 10.0)], "doc_id long, base double")
    rows = [(1, "Title", 18.0, False), (1, "Part", 17.7, False), (1, "12", 30.0, True), (1, "body", 10.0, False), (2, "Bold one", 11.0, True), (2, "12", 11.5, True), (2, "plain", 11.0, False)]
    got = P.heading_tiers(spark.createDataFrame(rows, "doc_id long, text string, first_size double, first_bold boolean"), base).collect()
    assert {r["doc_id"]: r["tiers"] for r in got} == {1: [18.0], 2: [11.0]}
    region = spark.createDataFrame([(1, 1, 7, 0.0, 0.0, 50.0, 120.0)], "doc_id long, page int, region_id long, x0 double, y0 double, x1 double, y1 double")
    near = items(spark, [("in", 0, 10, 10), ("touch", 51, 60, 10), ("off", 52, 60, 10), ("over", 40, 115, 30), ("none", 45, 0, 0)])
    (r,) = P.items_in_regions(near, region).collect()
    assert (r["n_items"], r["width"]) == (4, 10 + 10 + 30 + 20)


def column(spark, function, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").coalesce(1)
    return [r[0] for r in df.orderBy("k").select(function(F.col("v"))).collect()]


GARBLED = "hJkT bDmQ " * 30
ENGLISH = "when in the course of human events it becomes necessary for one people to dissolve the political bands which have connected them with another and to assume among the powers of the earth the separate and equal station to which the laws of nature entitle them"
SHIFTED = "".join(c if c == " " else chr((ord(c) - 97 + 7) % 26 + 97) for c in ENGLISH)
CASES = [
    (L.is_caption, {"Note: x": True, "Nota: y": True, "Fonte:z": True, "Source: x": True, "Note x": False, "table 3": True}),
    (L.is_heading_fragment, {"or inversely": True, "Or inversely": False, "S = kB ln W, (2)": True, "Nicaea (325)": False, "PM 2 (10)": True, "Rearranging Equation (8) gives:": True, "Procedure:": False, "": False}),
    (X.link_urls, {"see https://a.b/c.": "see [https://a.b/c](https://a.b/c).", "[x](https://a.b/c)": "[x](https://a.b/c)", "[go https://a.b/c now] http://d.e/": "[go https://a.b/c now] [http://d.e/](http://d.e/)", "no": "no"}),
    (lambda c: F.array_join(X.financial_values(c), "|"), {"$ 5,147 (1,5) —": "$ 5,147|(1,5)|—", "1 2 $": None, "Land 3": None, "": None, "- 2%": "-|2%"}),
    (lambda c: X.roman_value(c).cast("string"), {"xiv": "14", "CCXLIX": "249", "civil": None, "mix": None, "ill": None, "iiii": None, "": None}),
    (lambda c: X.better_decode(F.lit("wkh fdw"), c), {"the cat": "the cat", "": "wkh fdw", "zzz": "wkh fdw"}),
    (X.is_rtl, {"שלום world": False, "שלום ab": True, "世界 ש": True, "": False}),
    (Q.is_garbage, {"#@!%" * 20: True, "words " * 20: False, ".__" * 30: True, ".___" * 30: False, "....." * 20 + "ab": False}),
    (Q.is_cid_garbage, {"\x83\x84ab": False, "\x83\x84abc": True, "éèü" * 7: True, "éèü" * 6: False, "été à la mer, où l'on est bien": False}),
    (Q.has_dollar_spaces, {"a$b" * 12: True, "$5 " * 12: False, "a$b": False}),
    (Q.has_private_use_run, {"x": True, "xyz": False, "ab": True, "ab": False}),
    (lambda c: Q.looks_garbled(Q.cipher_evidence(c)), {GARBLED: True, SHIFTED: True, ENGLISH: False, "the quick brown fox jumps over the lazy dog " * 8: False, "hJkT": False, "п" * 400 + GARBLED: False}),
    (lambda c: R.page_range_error(c), {"1-999999999": "too many", "1,3-5": None, "0": "zero", "4-2": "descending", "x": "malformed", "": "malformed"}),
]


@pytest.mark.parametrize(("function", "cases"), CASES, ids=[str(k) for k in range(len(CASES))])
def test_literal_cases(spark, function, cases):
    assert dict(zip(cases, column(spark, function, list(cases)), strict=True)) == cases


def test_tables(spark):
    grid = lambda d, rows: [(d, r, c, t) for r, row in enumerate(rows) for c, t in enumerate(row)]
    rows = grid(1, [["Name:", "x"], ["Age:", "4"], ["SIZE (M)", ""]]) + grid(2, [[str(c) for c in range(20)]] * 3 + [["1"] + [""] * 19] * 9) + grid(3, [["a", "b"], ["a long cell of text that goes on", "and another one that does not end"]])
    got = {r["doc_id"]: r for r in T.table_checks(spark.createDataFrame(rows, "doc_id long, row int, col int, text string"), E.is_data_like).collect()}
    assert got[1]["key_value"] and got[1]["consistent"] and got[1]["table_like"]
    assert got[2]["cols"] == 20 and not got[2]["key_value"] and got[2]["consistent"] and got[2]["table_like"]
    assert not got[3]["table_like"]
    cells = spark.createDataFrame([(1, 0, 0, "a", 2), (2, 0, 0, "c", 99)], "doc_id long, row int, col int, text string, repeat int")
    assert sorted((r["doc_id"], r["col"], r["error"]) for r in T.repeated(cells, 10).fillna(-1, ["col"]).collect()) == [(1, 0, None), (1, 1, None), (2, -1, "limit")]


def test_calls():
    waits, tries = [], iter([transport.Reply(503), transport.Reply(429, "", "2"), transport.Reply(200, "<html>"), transport.Reply(200, '{"a": 1}')])
    assert transport.call(lambda: next(tries), 3, waits.append, lambda most: most) == {"a": 1}
    assert waits == [0.05, 2.0, 0.2]
    with pytest.raises(transport.CallFailed) as e:
        transport.call(lambda: transport.Reply(404, "no"), 3, waits.append)
    assert (e.value.attempts, e.value.status) == (1, 404)

    def broken():
        raise OSError("down")

    with pytest.raises(transport.CallFailed) as e:
        transport.call(broken, 2, lambda _: None)
    assert e.value.attempts == 3
    assert transport.most_backoff(1) == 50 and transport.most_backoff(9) == 5000 and transport.most_backoff(99) == 5000
    assert transport.retry_after("90") == 30_000 and transport.retry_after("Wed, 21 Oct") is None
    seen = []
    assert transport.steady(lambda t: seen.append(t) or ("ab" * 50 if t < 0.3 else "fine"), lambda x: x != "fine", 0.0) == "fine" and seen == [0.0, 0.2, 0.4]
    config = "# c\n[dots-ocr]\nendpoint = 'http://x'\n[other]\nmodel=m\n"
    assert transport.resolved("dots-ocr", None, None, config, {"PAGELATHE_MODEL": " v "}) == ("http://x", "v") and transport.resolved("other", "e", None, config, {}) == ("e", "m")
    assert transport.chat_request("m", "p", b"x", top_p=1)["messages"][0]["content"][0]["image_url"]["url"] == "data:image/png;base64,eA=="
    stages = transport.overridden({"ocr": transport.Stage("a")}, {"ocr": {"endpoint": "b"}})
    assert stages["ocr"] == transport.Stage("b")
    with pytest.raises(ValueError):
        transport.overridden({}, {"x": {}})


def test_pages_and_cache(spark, tmp_path, capsys):
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("a", None)], "path string, unit_no int")
    assert sorted(r["unit_no"] if r["unit_no"] is not None else -1 for r in api.only_pages(rows, (1, 3)).collect()) == [-1, 0, 2]
    assert api.only_pages(rows, ()).count() == 4
    folder = tmp_path / "cache"
    assert api.cache_stat(spark, f"file://{folder}") == {"entries": 0, "total_bytes": 0} and not api.cache_clear(spark, f"file://{folder}")
    folder.mkdir()
    (folder / "x").write_bytes(b"abc")
    assert api.cache_stat(spark, f"file://{folder}")["total_bytes"] == 3
    assert main(["cache", "stat", str(folder)]) == 0 and json.loads(capsys.readouterr().out) == {"entries": 1, "total_bytes": 3}
    assert main(["cache", "clear", str(folder)]) == 0 and not folder.exists()
    assert main(["doctor"]) == 0 and "pyspark" in capsys.readouterr().out
    assert pages_of("1, 3-4") == {1, 3, 4}
    f = tmp_path / "a.csv"
    f.write_text("a,b\nx,y\n")
    assert main(["parse", str(f), "--pages", "2"]) == 0 and capsys.readouterr().out.strip() == ""
    assert main(["parse", str(f), "--pages", "1-999999999"]) == 1
    with pytest.raises(ValueError):
        api.parse(rows, api.ParseOptions(protocol="nope"))
    endpoint, body = api.request(api.ParseOptions(protocol="dots-ocr", endpoint="http://e", model="m"), "hi")
    assert endpoint == "http://e" and body["model"] == "m"


def test_columns_of_pages():
    rnd = np.random.default_rng(3)
    left = [(50.0, 220 + rnd.integers(0, 8), 700.0 - 12 * k) for k in range(30)]
    right = [(310.0, 220 + rnd.integers(0, 8), 700.0 - 12 * k) for k in range(30)]
    x, w, y = (np.array(c, float) for c in zip(*left, *right, (50.0, 480.0, 740.0), strict=True))
    none = np.zeros(len(x), bool)
    edges = C.column_edges(x, w, y, none)
    assert len(edges) == 3 and 278 < edges[1] < 310
    assert C.column_of_items(edges, x, w, y).tolist() == [0] * 30 + [1] * 30 + [-1]
    assert len(C.column_edges(x[:30], w[:30], y[:30], none[:30])) == 2
    bullets = np.array([True] * 30 + [False] * 31)
    assert len(C.column_edges(np.where(bullets, 50.0, 300.0), np.where(bullets, 5.0, 220.0), y, bullets)) in (2, 3)
    assert C.column_edges(np.array([50.0] * 12 + [300.0] * 12), np.array([5.0] * 12 + [220.0] * 12), np.array([700.0 - 12 * k for k in range(12)] * 2), np.array([True] * 12 + [False] * 12))[1:-1] in ([], [177.5])


def markdown(spark, rows, **options):
    got = M.markdown_of_items(items(spark, rows), M.MarkdownOptions(**options)).collect()
    return got[0]["markdown"] if got else ""


def test_markdown_of_lines(spark):
    body = [(f"body text of line {k} that fills the page", 50, 600 - 12 * k, 400) for k in range(6)]
    page = [("A Large Heading", 50, 700, 150, {"font_size": 18}), ("Figure 3 shows it", 50, 660, 100), *body, ("• one item", 60, 500, 60), ("that goes on", 70, 488, 60), ("2) next item", 60, 476, 60), ("x = f(y)", 50, 430, 60, {"font": "Courier"}), ("return x", 50, 418, 60, {"font": "Courier"}), ("See http://a.example/b.", 50, 380, 120), ("12", 300, 20, 10)]
    out = markdown(spark, page)
    assert out.startswith("# A Large Heading\n\nFigure 3 shows it\n\nbody text of line 0 that fills the page body text of line 1")
    assert "- one item that goes on\n2) next item\n" in out and "```\nx = f(y)\nreturn x\n```" in out
    assert "See [http://a.example/b](http://a.example/b)." in out and not out.rstrip().endswith("12")
    assert "http://a.example/b](" not in markdown(spark, page, link_urls=False) and markdown(spark, page, page_numbers_out=False).rstrip().endswith("12")
    assert markdown(spark, page, page_marks=True).startswith("<!-- Page 1 -->\n\n# A") and "# A" not in markdown(spark, page, headings=False)
    assert markdown(spark, [(f"plain {k}", 50, 600 - 12 * k, 300) for k in range(6)] + [("bold", 50, 528, 20, {"bold": True})] + [("end of it", 75, 528, 60)]).endswith("**bold** end of it\n")


def test_paddle_and_order(spark):
    body = json.dumps({"rec_texts": ["b", "a"], "rec_polys": [[[0, 20], [50, 20], [50, 30], [0, 30]], [[0, 0], [50.4, 0], [50, 10], [0, 10]]]})
    got = api.replies_to_blocks(spark.createDataFrame([(1, body), (2, "x")], "doc_id long, body string"), "paddleocr").withColumn("page", F.lit(1))
    rows = sorted(api.in_reading_order(got).collect(), key=lambda r: r["reading_order"])
    assert [(r["text"], r["x1"], r["category"]) for r in rows] == [("a", 50, "text"), ("b", 50, "text")]
