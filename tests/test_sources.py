import io
import random
import zipfile
import zlib

import pytest
from pagelathe.sources import files, pdf, plain
from pagelathe.sources.model import DocumentError, Limits, Options, Run, Style, inline, list_label
from pagelathe.sources.package import detect

W = 'xmlns:w="http://w" xmlns:r="http://r"'


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def rels(main, kind="officeDocument"):
    return f'<Relationships xmlns="http://p"><Relationship Id="rId1" Type="http://x/{kind}" Target="{main}"/></Relationships>'


def docx():
    body = f"""<w:document {W}><w:body>
    <w:p><w:pPr><w:pStyle w:val="H2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p>
    <w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t xml:space="preserve"> a*b </w:t></w:r><w:hyperlink r:id="rId9"><w:r><w:t>link</w:t></w:r></w:hyperlink><w:r><w:footnoteReference w:id="2"/></w:r></w:p>
    <w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="5"/></w:numPr></w:pPr><w:r><w:t>one</w:t></w:r></w:p>
    <w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="5"/></w:numPr></w:pPr><w:r><w:t>two</w:t></w:r></w:p>
    <w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
    </w:body></w:document>"""
    styles = f'<w:styles {W}><w:style w:type="paragraph" w:styleId="H2"><w:name w:val="x"/><w:basedOn w:val="Base"/></w:style><w:style w:type="paragraph" w:styleId="Base"><w:name w:val="heading 2"/></w:style></w:styles>'
    numbering = f'<w:numbering {W}><w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:start w:val="3"/><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="1"/></w:num></w:numbering>'
    notes = f'<w:footnotes {W}><w:footnote w:id="2"><w:p><w:r><w:t>a note</w:t></w:r></w:p></w:footnote></w:footnotes>'
    own = '<Relationships xmlns="http://p"><Relationship Id="rId9" Type="http://x/hyperlink" Target="http://a b" TargetMode="External"/><Relationship Id="rId3" Type="http://x/footnotes" Target="footnotes.xml"/></Relationships>'
    return package(**{"_rels/.rels": rels("word/document.xml"), "word/document.xml": body, "word/styles.xml": styles, "word/numbering.xml": numbering, "word/footnotes.xml": notes, "word/_rels/document.xml.rels": own})


def pptx():
    slide = lambda t: f'<p:sld xmlns:p="http://p" xmlns:a="http://a"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp><p:sp><p:nvPr><p:ph/></p:nvPr><p:txBody><a:p><a:r><a:t>point</a:t></a:r></a:p></p:txBody></p:sp></p:sld>'
    main = '<p:presentation xmlns:p="http://p" xmlns:r="http://r"><p:sldIdLst><p:sldId id="300" r:id="rId2"/><p:sldId id="256" r:id="rId1"/></p:sldIdLst></p:presentation>'
    own = '<Relationships xmlns="http://q"><Relationship Id="rId1" Type="http://x/slide" Target="slides/slide1.xml"/><Relationship Id="rId2" Type="http://x/slide" Target="slides/slide2.xml"/></Relationships>'
    return package(**{"_rels/.rels": rels("ppt/presentation.xml"), "ppt/presentation.xml": main, "ppt/_rels/presentation.xml.rels": own, "ppt/slides/slide1.xml": slide("First"), "ppt/slides/slide2.xml": slide("Second")})


def xlsx():
    sheet = '<worksheet xmlns="http://s"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>when</t></is></c></row><row r="2"><c r="A2"><f>1+1</f><v>2.50</v></c><c r="B2" s="1"><v>45292</v></c></row><row r="3"><c r="A3" t="b"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A3:B3"/><mergeCell ref="A9:B9"/></mergeCells></worksheet>'
    return package(**{
        "_rels/.rels": rels("xl/workbook.xml"), "xl/workbook.xml": '<workbook xmlns="http://s" xmlns:r="http://r"><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rels("worksheets/sheet1.xml", "worksheet"),
        "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": '<sst xmlns="http://s"><si><t>val</t></si></sst>', "xl/styles.xml": '<styleSheet xmlns="http://s"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    })


O = 'xmlns:office="urn:o" xmlns:text="urn:t" xmlns:table="urn:b" xmlns:style="urn:s" xmlns:fo="urn:f"'


def odt():
    content = f'<office:document-content {O}><office:automatic-styles><style:style style:name="B"><style:text-properties fo:font-weight="bold"/></style:style></office:automatic-styles><office:body><office:text><text:h text:outline-level="2">Head</text:h><text:p>a <text:span text:style-name="B">b</text:span></text:p><text:list><text:list-item><text:p>i1</text:p></text:list-item><text:list-item><text:p>i2</text:p></text:list-item></text:list></office:text></office:body></office:document-content>'
    return package(**{"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": content})


def ods(times=2):
    content = f'<office:document-content {O}><office:body><office:spreadsheet><table:table table:name="T"><table:table-row><table:table-cell><text:p>h1</text:p></table:table-cell><table:table-cell><text:p>h2</text:p></table:table-cell></table:table-row><table:table-row table:number-rows-repeated="{times}"><table:table-cell office:value-type="float" table:number-columns-repeated="2"><text:p>7</text:p></table:table-cell></table:table-row></table:table></office:spreadsheet></office:body></office:document-content>'
    return package(**{"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": content})


def epub():
    opf = '<package xmlns="http://o"><metadata><title>Book</title></metadata><manifest><item id="a" href="a.xhtml" media-type="x"/><item id="b" href="b.xhtml" media-type="x"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>'
    return package(**{"mimetype": "application/epub+zip", "META-INF/container.xml": '<container xmlns="http://c"><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>', "O/c.opf": opf, "O/a.xhtml": "<html><body><h1>A</h1><p>x</p></body></html>", "O/b.xhtml": "<html><body><h1>B</h1><ol><li>k</li></ol></body></html>"})


RTF = b"".join([rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}\pard Caf\'e9 {\b bold} ", b"\x5cu8364?uro", rb"\par{\field{\*\fldinst HYPERLINK ", b'"http://x"', rb"}{\fldrslt here}}\par\trowd\intbl a\cell b\cell\row\pard end{\footnote a note}\par}"])


def pdf_file(compressed=True):
    content = b"BT /F1 12 Tf 72 700 Td (Hello) Tj 40 0 Td (wor) Tj (ld) Tj 0 -20 Td [(Se) -20 (cond \\(x\\))] TJ ET 10 10 100 1 re f"
    data = zlib.compress(content) if compressed else content
    parts = [
        b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 612 792]/Resources<</Font<</F1 4 0 R>>>>/Contents 5 0 R>>",
        b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/FirstChar 32/LastChar 126/Widths[" + b"500 " * 95 + b"]>>", b"<</Length %d%s>>stream\n%s\nendstream" % (len(data), b"/Filter/FlateDecode" if compressed else b"", data),
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, p) for k, p in enumerate(parts, 1)) + b"trailer<</Root 1 0 R>>\n%%EOF"


FIXTURES = {"docx": docx(), "pptx": pptx(), "xlsx": xlsx(), "odt": odt(), "ods": ods(), "epub": epub(), "rtf": RTF, "pdf": pdf_file(), "csv": b"\xef\xbb\xbfname;n\nx;1\ny;2\n", "html": b"<html><body><p>x</p></body></html>"}


def test_detection():
    for fmt, data in FIXTURES.items():
        assert detect(data, "f.csv" if fmt == "csv" else "f") == fmt
    assert detect(b"", "a.bin") == "unknown" and detect(b"PK\x03\x04junk") == "unknown"


@pytest.mark.parametrize(
    ("fmt", "markdown"),
    [
        ("docx", '## Head\n\n**bold** a\\*b [link](<http://a b>)[^f2]\n\n3. one\n4. two\n\n<table>\n<tr><th colspan="2">wide</th></tr>\n<tr><td>1</td><td>x</td></tr>\n</table>\n\n[^f2]: a note\n'),
        ("pptx", "# Slide 1\n\n# Second\n\n- point\n\n# Slide 2\n\n# First\n\n- point\n"),
        ("odt", "## Head\n\na **b**\n\n- i1\n- i2\n"),
        ("ods", "# T\n\n| h1 | h2 |\n| --- | --- |\n| 7 | 7 |\n| 7 | 7 |\n"),
        ("epub", "# B\n\n1. k\n\n# A\n\nx\n"),
        ("csv", "| name | n |\n| --- | --- |\n| x | 1 |\n| y | 2 |\n"),
        ("pdf", "Hello world\n\nSecond (x)\n"),
    ],
)
def test_markdown(fmt, markdown):
    assert files.to_markdown(FIXTURES[fmt], f"f.{fmt}") == markdown


def test_rich_text():
    d = files.parse(RTF)
    blocks = d.units[0].blocks
    assert blocks[0].text == "Café **bold** €uro" and blocks[1].text == "[here](http://x)"
    assert [c.text for c in blocks[2].cells] == ["a", "b"] and blocks[3].text == "end[^1]" and d.notes == [("footnote", "1", "a note")]


def test_sheet():
    d = files.parse(FIXTURES["xlsx"])
    (table,) = d.units[0].blocks
    got = {(c.row, c.col): (c.text, c.kind) for c in table.cells}
    assert got[1, 0] == ("2.5", "number") and got[1, 1] == ("2024-01-01", "datetime") and got[2, 0] == ("TRUE", "boolean") and (2, 1) not in got
    assert table.header_rows == 1 and d.warnings == [("merge", "A9:B9")] and table.cells[2].formula == "1+1"


def test_html_blocks():
    page = "<html><head><title>T</title><script>x</script></head><body><nav><ul><li><a href='/a'>l</a></li></ul></nav><h2>H &amp; i</h2><p>a <b>b<br>c</b><p>d<pre>x\n  y</pre><blockquote>q</blockquote><table><tr><th>h</th></tr><tr><td>1</td></tr></table>"
    assert files.to_markdown(page.encode(), "x.html") == "- [l](/a)\n\n## H &amp; i\n\na **b c**\n\nd\n\n```\nx\n  y\n```\n\n> q\n\n| h |\n| --- |\n| 1 |\n"


def test_pdf_items_and_pages():
    for data in (pdf_file(), pdf_file(False), b"junk" + pdf_file(), pdf_file().replace(b"%%EOF", b"")):
        (page,) = pdf.read_pages(data, Options())
        assert [i["text"] for i in page.items] == ["Hello", "wor", "ld", "Se", "cond (x)"] and page.items[0]["x"] == 72 and page.items[1]["x"] == 112
        assert page.text_ops == 4 and page.rects == [(10.0, 10.0, 100.0, 1.0)]
    assert pdf.page_estimate(pdf_file()) == 1
    with pytest.raises(DocumentError, match="encrypted"):
        files.parse(pdf_file().replace(b"trailer<<", b"trailer<</Encrypt 9 0 R"))


def test_to_unicode_maps():
    assert pdf._codes(b"1 beginbfchar <01> <0041> endbfchar 1 beginbfrange <02> <04> <0061> <05> <06> [<0078> <0079>] endbfrange") == {1: "A", 2: "a", 3: "b", 4: "c", 5: "x", 6: "y"}


def test_control_text():
    blocks = plain.blocks_from_control_text("Head\rA\x07B\x07\x07\x13 LINK x \x14shown\x15 t\x0bu\r\x0cend")
    assert [(b.type, b.text) for b in blocks] == [("paragraph", "Head"), ("table", ""), ("paragraph", "shown t u"), ("rule", ""), ("paragraph", "end")]


def test_limits_and_errors():
    small = Options(limits=Limits(expansion=5))
    with pytest.raises(DocumentError, match="limit"):
        files.parse(ods(1000), "", small)
    with pytest.raises(DocumentError, match="limit"):
        files.parse(b"x" * 10, "a.txt", Options(limits=Limits(input_bytes=5)))
    with pytest.raises(DocumentError, match="unsupported"):
        files.parse(b"\0\1", "a.bin")
    bomb = docx().replace(b"[Content", b"[Content")
    with pytest.raises(DocumentError, match="entities"):
        files.parse(package(**{"_rels/.rels": rels("word/document.xml"), "word/document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>'}))
    assert bomb


def test_mutated_files_never_break_out():
    rnd = random.Random(4)
    for data in FIXTURES.values():
        for _ in range(60):
            broken = bytearray(data)
            for _ in range(rnd.randrange(1, 6)):
                broken[rnd.randrange(len(broken))] = rnd.randrange(256)
            try:
                files.parse(bytes(broken[: rnd.randrange(len(broken) // 2, len(broken) + 1)]), "f.csv")
            except DocumentError:
                pass


def test_inline_and_labels():
    assert inline([Run("a ", Style(bold=True)), Run("b", Style(bold=True)), Run(" c_d _e", Style())]) == "**a b** c_d \\_e"
    assert [list_label(m, n) for m, n in (("bullet", 1), ("decimal", 3), ("lower_alpha", 28), ("upper_roman", 14))] == ["-", "3.", "- ab.", "- XIV."]


def test_rows(spark):
    df = spark.createDataFrame([(f"f.{k}", bytearray(v)) for k, v in FIXTURES.items()] + [("bad.bin", bytearray(b"\0")), ("null.csv", None)], "path string, content binary")
    rows = files.parsed(df)
    errors = {r["path"]: r["code"] for r in rows.where("record = 'error'").collect()}
    assert errors == {"bad.bin": "unsupported"}
    assert rows.where("record = 'note'").count() == 2
    md = {r["path"]: r["markdown"] for r in files.markdown(rows).collect()}
    assert md["f.odt"] == "## Head\n\na **b**\n\n- i1\n\n- i2"
    items = files.pdf_items(df).collect()
    assert [i["text"] for i in items] == ["Hello", "wor", "ld", "Se", "cond (x)"]
    (kind,) = files.pdf_kinds(files.pdf_pages(df)).collect()
    assert kind["kind"] == "text_based" and kind["ocr_pages"] == []
    tiny = files.parsed(df.where("path = 'f.csv'"), Options(limits=Limits(input_bytes=3))).collect()
    assert [(r["record"], r["code"]) for r in tiny] == [("error", "limit")]


def test_streaming_windows(spark, tmp_path):
    from pagelathe.streaming import ingest

    for fmt in ("csv", "rtf", "odt"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"f.{fmt}").write_bytes(FIXTURES[fmt])
    (tmp_path / "in" / "bad.bin").write_bytes(b"\0\0")
    for _ in range(2):
        query = ingest.write_windows(ingest.arriving(spark, str(tmp_path / "in"), window=2), str(tmp_path / "out"), str(tmp_path / "check"))
        query.awaitTermination()
    blocks = spark.read.json(str(tmp_path / "out" / "block"))
    assert blocks.select("path").distinct().count() == 3 and blocks.select("window").distinct().count() == 2
    assert spark.read.json(str(tmp_path / "out" / "error")).count() == 1
