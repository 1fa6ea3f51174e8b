"""Files as rows: (path, content) in, blocks, items, notes, assets and errors out. A file that fails gives an error row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.sources import html, office, pdf, plain
from pagelathe.sources.model import Document, DocumentError, Options, Unit, block_markdown, document_markdown
from pagelathe.sources.model import Block as DocumentBlock
from pagelathe.sources.package import detect

READERS: dict[str, Callable[[bytes, Options], Document]] = {
    "csv": plain.read_delimited,
    "tsv": lambda d, o: plain.read_delimited(d, o, "\t"),
    "text": plain.read_text,
    "rtf": plain.read_rtf,
    "html": html.read,
    "docx": office.read_docx,
    "pptx": office.read_pptx,
    "xlsx": office.read_xlsx,
    "odt": lambda d, o: office.read_odf(d, o, "odt"),
    "ods": lambda d, o: office.read_odf(d, o, "ods"),
    "odp": lambda d, o: office.read_odf(d, o, "odp"),
    "epub": office.read_epub,
    "doc": office.read_doc,
    "pdf": lambda d, o: _pdf_document(d, o),
}

#: Rows, and bytes of files, that go into one batch; a larger file makes a batch of its own.
MOST_ROWS, MOST_BYTES = 2_000, 8_000_000

BLOCKS = (
    "path string, format string, record string, unit_no int, unit_kind string, unit_label string, block_no int, type string, level int, depth int, marker string, ordinal int, text string, markdown string,"
    " cells array<struct<row:int,col:int,row_span:int,col_span:int,kind:string,text:string,formula:string>>, name string, media_type string, content binary, code string"
)
ITEMS = "path string, page int, item_no int, text string, x double, y double, width double, height double, font string, font_size double, url string"
PAGES = "path string, page int, text_ops int, image_count int, path_ops int, font_changes int, fonts int, undecodable_fonts int, type3_fonts int, chars int"


def parse(data: bytes, name: str = "", options: Options | None = None) -> Document:
    """A document of any readable format."""
    options = options or Options()
    if len(data) > options.limits.input_bytes:
        raise DocumentError("limit", "file too large")
    fmt = detect(data, name)
    if fmt not in READERS:
        raise DocumentError("unsupported", fmt)
    try:
        return READERS[fmt](data, options)
    except DocumentError:
        raise
    except (ValueError, KeyError, IndexError, TypeError, AttributeError, RecursionError, OverflowError) as e:
        raise DocumentError("malformed", f"{type(e).__name__}: {e}") from None


def to_markdown(data: bytes, name: str = "", options: Options | None = None) -> str:
    return document_markdown(parse(data, name, options))


def _pdf_document(data: bytes, options: Options) -> Document:
    """Rows of text a page, by the vertical place of the items; finer layout is left to the operators on items."""
    document = Document("pdf")
    for k, page in enumerate(pdf.read_pages(data, options), 1):
        blocks, row, last = [], [], None
        for item in sorted((i for i in page.items if i["text"].strip()), key=lambda i: (-i["y"], i["x"])):
            if last is not None and abs(last["y"] - item["y"]) > max(0.6 * max(last["height"], item["height"]), 1):
                blocks.append(row)
                row = []
            row.append(item)
            last = item
        blocks += [row] if row else []
        texts = []
        for own in blocks:
            own.sort(key=lambda i: i["x"])
            line = ""
            for n, i in enumerate(own):
                line += (" " if n and i["x"] - own[n - 1]["x"] - own[n - 1]["width"] > 0.15 * i["font_size"] else "") + i["text"]
            texts.append(line)
        document.units.append(Unit("page", None, [DocumentBlock("paragraph", t) for t in texts]))
    return document


def _rows(path: str, d: Document) -> Iterator[dict]:
    for u, unit in enumerate(d.units):
        for k, b in enumerate(unit.blocks):
            cells = [{"row": c.row, "col": c.col, "row_span": c.row_span, "col_span": c.col_span, "kind": c.kind, "text": c.text, "formula": c.formula} for c in b.cells]
            yield {"path": path, "format": d.format, "record": "block", "unit_no": u, "unit_kind": unit.kind, "unit_label": unit.label, "block_no": k, "type": b.type, "level": b.level, "depth": b.depth, "marker": b.marker, "ordinal": b.ordinal, "text": b.text, "markdown": block_markdown(b), "cells": cells}
    for kind, ident, text in d.notes:
        yield {"path": path, "format": d.format, "record": "note", "type": kind, "name": ident, "text": text}
    for name, media, content in d.assets:
        yield {"path": path, "format": d.format, "record": "asset", "name": name, "media_type": media, "content": content}
    for code, text in d.warnings:
        yield {"path": path, "format": d.format, "record": "warning", "code": code, "text": text}


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _mapped(files: DataFrame, schema: str, rows: Callable[[str, bytes], Iterator[dict]]) -> DataFrame:
    kind = _arrow(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[dict] = []
            size = 0
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_py()
                own = list(rows(path.as_py(), bytes(data) if data is not None else b""))
                held += own
                size += len(data or b"") + len(own)
                if len(held) >= MOST_ROWS or size >= MOST_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema=kind)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=kind)

    return files.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(work, schema)


def parsed(files: DataFrame, options: Options | None = None) -> DataFrame:
    """Rows of BLOCKS of each file (path, content): blocks, notes, assets, warnings, or one error with its code.

    Files larger than the limit are told by their length, before their content is read into Python.
    """
    options = options or Options()
    most = options.limits.input_bytes
    content = F.when(F.octet_length("content") <= most, F.col("content"))
    large = F.coalesce(F.octet_length("content") > most, F.lit(False))

    def rows(path: str, data: bytes) -> Iterator[dict]:
        try:
            yield from _rows(path, parse(data, path or "", options))
        except DocumentError as e:
            yield {"path": path, "record": "error", "code": e.code, "text": e.detail}

    good = _mapped(files.where(~large).select("path", content.alias("content")), BLOCKS, rows)
    empty = {f.name: f.dataType for f in good.schema.fields}
    bad = files.where(large).select(*[{"path": F.col("path"), "record": F.lit("error"), "code": F.lit("limit"), "text": F.lit("file too large")}.get(n, F.lit(None)).cast(t).alias(n) for n, t in empty.items()])
    return good.unionByName(bad)


def markdown(blocks: DataFrame) -> DataFrame:
    """(path, markdown) of the block rows of parsed(), in order."""
    own = blocks.where("record = 'block' AND trim(markdown) <> ''").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("unit_no", "block_no", "markdown"))).alias("b"))
    return own.select("path", F.array_join(F.transform("b", lambda x: x["markdown"]), "\n\n").alias("markdown"))


def pdf_items(files: DataFrame, options: Options | None = None) -> DataFrame:
    """Rows of ITEMS of PDF files; of other files and of unreadable ones none."""
    options = options or Options()

    def rows(path: str, data: bytes) -> Iterator[dict]:
        try:
            for k, page in enumerate(pdf.read_pages(data, options), 1):
                for n, item in enumerate(page.items):
                    yield {"path": path, "page": k, "item_no": n, **item}
        except DocumentError:
            return

    return _mapped(files, ITEMS, rows)


def pdf_pages(files: DataFrame, options: Options | None = None) -> DataFrame:
    """Rows of PAGES: what each page of PDF files is made of."""
    options = options or Options()

    def rows(path: str, data: bytes) -> Iterator[dict]:
        try:
            for k, p in enumerate(pdf.read_pages(data, options), 1):
                counts = {c: getattr(p, c) for c in ("text_ops", "image_count", "path_ops", "font_changes", "fonts", "undecodable_fonts", "type3_fonts")}
                yield {"path": path, "page": k, **counts, "chars": sum(len(i["text"]) for i in p.items)}
        except DocumentError:
            return

    return _mapped(files, PAGES, rows)


def pdf_kinds(pages: DataFrame) -> DataFrame:
    """(path, pages, text_pages, image_pages, kind, ocr_pages): text, scanned, image or mixed, and which pages lack text."""
    text, image = (F.col("text_ops") >= 3) & (F.col("undecodable_fonts") < F.greatest(F.col("fonts"), F.lit(1))), F.col("image_count") > 0
    sums = pages.groupBy("path").agg(
        F.count("*").alias("pages"), F.sum(text.cast("long")).alias("text_pages"), F.sum((image & ~text).cast("long")).alias("image_pages"), F.array_sort(F.collect_set(F.when(~text, F.col("page")))).alias("ocr_pages")
    )
    kind = F.when(F.col("text_pages") >= F.col("pages") * 0.6, "text_based").when(F.col("text_pages") > 0, "mixed").when(F.col("image_pages") == F.col("pages"), "scanned").otherwise("image_based")
    return sums.withColumn("kind", kind)


def signature(content: Column, path: Column) -> Column:
    """The format by signature and extension alone, without Python; packages are "zip" or "ole"."""
    head = F.hex(F.substring(content, 1, 8))
    starts = lambda x: head.startswith(x)
    return (
        F.when(starts("7B5C727466"), "rtf").when(starts("D0CF11E0A1B11AE1"), "ole").when(starts("504B0304"), "zip").when(starts("255044462D"), "pdf")
        .when(starts("89504E470D0A1A0A"), "png").when(starts("FFD8FF"), "jpeg").when(F.lower(path).endswith(".csv"), "csv").when(F.lower(path).endswith(".tsv"), "tsv").otherwise("unknown")
    )


def read_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, modificationTime, length, content) of files; the length filter of a query reaches the scan."""
    return spark.read.format("binaryFile").load(glob)
