import json

from pagelathe import api
from pagelathe.__main__ import main
from pyspark.sql import functions as F


def test_command(tmp_path, capsys):
    f = tmp_path / "a.csv"
    f.write_text("a,b\nx,y\n")
    assert main(["parse", str(f)]) == 0 and capsys.readouterr().out == "| a | b |\n| --- | --- |\n| x | y |\n"
    assert main(["parse", str(f), "--json"]) == 0 and json.loads(capsys.readouterr().out)["format"] == "csv"
    assert main(["classify", str(f)]) == 0 and json.loads(capsys.readouterr().out)["format"] == "csv"
    assert main(["protocols"]) == 0 and "mineru-vlm" in capsys.readouterr().out
    bad = tmp_path / "b.bin"
    bad.write_bytes(b"\0")
    assert main(["parse", str(bad)]) == 1 and json.loads(capsys.readouterr().err)["error"] == "unsupported"
    assert main(["parse", str(tmp_path / "none")]) == 1


def test_classify_and_errors(spark):
    df = spark.createDataFrame([("a.csv", bytearray(b"x")), ("b", bytearray(b"%PDF-1.4")), ("c", None)], "path string, content binary")
    got = {r["path"]: (r["format"], r["kind"], r["route"]) for r in api.classify(df).collect()}
    assert got == {"a.csv": ("csv", "spreadsheet", "pipeline"), "b": ("pdf", "unknown", "mineru-vlm"), "c": ("unknown", "unknown", "mineru-vlm")}
    codes = spark.createDataFrame([(None,), ("limit",), ("odd",)], "c string").select(api.error_class(F.col("c")))
    assert [r[0] for r in codes.collect()] == ["ok", "input", "internal"]


def test_replies(spark):
    tokens = "<|box_start|>10 20 5 1200<|box_end|><|ref_start|>Text<|ref_end|><|rotate_up|>\nnothing\n<|box_start|>1 1 1 9<|box_end|><|ref_start|>text<|ref_end|>"
    cells = '[{"bbox": [1, 2, 3.6, 4], "category": "Section-header", "text": "t"}, {"bbox": [1, 2, 3, 4], "category": "Odd", "text": null}]'
    one = lambda body: spark.createDataFrame([(1, body)], "doc_id long, body string")
    (row,) = api.replies_to_blocks(one(tokens), "mineru-vlm").collect()
    assert (row["x0"], row["y0"], row["x1"], row["y1"], row["rotation"], row["category"], row["warning"]) == (5, 20, 10, 1000, "up", "text", None)
    got = sorted(api.replies_to_blocks(one(cells), "dots-ocr").collect(), key=lambda r: r["line_no"])
    assert [(r["x1"], r["category"]) for r in got] == [(4, "title"), (3, "unknown")] and got[1]["warning"] == "unrecognized category: Odd"


def test_answers_by_key(spark):
    asked = spark.createDataFrame([(1, 1, "e", "layout"), (1, 2, "e", "layout")], "doc_id long, page int, endpoint string, stage string")
    replies = spark.createDataFrame([(1, 2, "e", "layout", "x")], "doc_id long, page int, endpoint string, stage string, body string")
    assert {r["page"]: r["body"] for r in api.answered(asked, replies).collect()} == {1: None, 2: "x"}
    assert api.ParseOptions(window=2, concurrency=9).effective_window == 9
