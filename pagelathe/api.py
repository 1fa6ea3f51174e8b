"""Entry points: parse, classify and render files, with options, error codes and the registry of model protocols."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe import transport
from pagelathe.operators import model_output
from pagelathe.operators import pdf_markdown as pdf_layout
from pagelathe.functions import geometry as G
from pagelathe.operators.documents import format_profile, route
from pagelathe.operators.layout import reading_order
from pagelathe.sources import files
from pagelathe.sources.model import Document, DocumentError, Limits, Options, document_markdown
from pagelathe.sources.package import detect

#: Exit codes of a command: all well, bad input, missing dependency, some pages failed, internal.
EXIT_CODES = {"ok": 0, "input": 1, "dependency": 2, "partial": 3, "internal": 4}


@dataclass(frozen=True)
class ParseOptions:
    protocol: str = "auto"
    endpoint: str | None = None
    model: str | None = None
    window: int = 64
    concurrency: int = 16
    pages: tuple[int, ...] = ()
    assets: bool = True
    notes: bool = True
    headers_footers: bool = False
    limits: Limits = field(default_factory=Limits)

    def reader(self) -> Options:
        return Options(self.limits, self.assets, self.notes, self.headers_footers)

    @property
    def effective_window(self) -> int:
        """A window is never smaller than what may run at once."""
        return max(self.window, self.concurrency)


def _json_cells(replies: DataFrame) -> DataFrame:
    cells = replies.select("doc_id", F.posexplode(model_output.json_cells(F.col("body"))).alias("line_no", "c"))
    corner = lambda k: F.round(F.col("c.bbox")[k]).cast("int")
    return cells.select("doc_id", "line_no", *[corner(k).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))], F.col("c.category").alias("raw"), F.col("c.text").alias("text"))


def _polygons(replies: DataFrame) -> DataFrame:
    """Boxes of replies that are lists of polygons with text: {"rec_texts": [...], "rec_polys": [[[x, y], ...], ...]}."""
    kind = "struct<rec_texts:array<string>,rec_polys:array<array<array<double>>>>"
    found = replies.select("doc_id", F.from_json("body", kind).alias("r")).select("doc_id", F.posexplode(F.arrays_zip("r.rec_texts", "r.rec_polys")).alias("line_no", "c"))
    points = F.transform("c.rec_polys", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    b = G.bounds(points)
    return found.where(F.size("c.rec_polys") > 0).select("doc_id", "line_no", *[F.round(b[k]).cast("int").alias(k) for k in ("x0", "y0", "x1", "y1")], F.lit("text").alias("raw"), F.col("c.rec_texts").alias("text"))


def in_reading_order(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, page, line_no, x0, y0, x1, y1, ...) with reading_order by recursive cuts, for protocols that give none."""
    return blocks.join(reading_order(blocks.withColumnRenamed("line_no", "idx")).withColumnRenamed("idx", "line_no"), ["doc_id", "page", "line_no"])


#: Protocol to the function that turns its replies (doc_id, body) into boxes. Replies come as a DataFrame; no call is made.
PROTOCOLS: dict[str, Callable[[DataFrame], DataFrame]] = {"mineru-vlm": model_output.layout_tokens, "dots-ocr": _json_cells, "monkeyocr-v2": _json_cells, "pipeline": _json_cells, "paddleocr": _polygons}


def replies_to_blocks(replies: DataFrame, protocol: str) -> DataFrame:
    """Boxes with their common category and warnings, of a protocol's replies."""
    if protocol not in PROTOCOLS:
        raise ValueError(f"unknown protocol {protocol!r}; known: {', '.join(sorted(PROTOCOLS))}")
    return model_output.with_category(PROTOCOLS[protocol](replies).withColumn("protocol", F.lit(protocol)))


def answered(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """requests (doc_id, page, endpoint, stage, ...) with the body of the reply to each, null where none came."""
    return requests.join(replies.select("doc_id", "page", "endpoint", "stage", "body"), ["doc_id", "page", "endpoint", "stage"], "left")


def only_pages(rows: DataFrame, pages: tuple[int, ...]) -> DataFrame:
    """Rows of parsed() of the pages asked for, counted from 1; what belongs to no page stays. All, if none is asked for."""
    return rows.where(F.col("unit_no").isNull() | (F.col("unit_no") + 1).isin(list(pages))) if pages else rows


def parse(df: DataFrame, options: ParseOptions | None = None) -> DataFrame:
    """Rows of files (path, content), of options.pages only, read by up to options.concurrency tasks at a time.

    Protocols other than native read no files: their replies go through replies_to_blocks().
    """
    options = options or ParseOptions()
    if options.protocol not in ("auto", "native", *PROTOCOLS):
        raise ValueError(f"unknown protocol {options.protocol!r}")
    return only_pages(files.parsed(df.repartition(options.concurrency), options.reader()), options.pages)


def pdf_markdown(df: DataFrame, options: pdf_layout.MarkdownOptions | None = None, pages: tuple[int, ...] = ()) -> DataFrame:
    """(doc_id, markdown) of PDF files (path, content) by the full layout: columns, headings, lists, code; of pages only, if given."""
    items = pdf_layout.styled(files.pdf_items(df))
    return pdf_layout.markdown_of_items(items.where(F.col("page").isin(list(pages))) if pages else items, options)


def ingest(df: DataFrame, options: ParseOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """(profiles, rows) of files (path, content) in one call: what classify() tells of each, and what parse() reads of it."""
    return classify(df), parse(df, options)


def parse_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, options: ParseOptions | None = None):
    """Parse files as they arrive in a folder, in windows of options.effective_window files."""
    from pagelathe.streaming import ingest

    return ingest.write_windows(ingest.arriving(spark, folder, (options or ParseOptions()).effective_window), out, checkpoint)


def request(options: ParseOptions, prompt: str, png: bytes | None = None, config: str = "", **sampling: object) -> tuple[str | None, dict]:
    """(endpoint, body) of a chat request of options' protocol; endpoint and model as given, by environment or configuration."""
    endpoint, model = transport.resolved(options.protocol, options.endpoint, options.model, config)
    return endpoint, transport.chat_request(model or "", prompt, png, **sampling)


def cache_clear(spark: SparkSession, folder: str) -> bool:
    """Delete a cache folder, on any file system; False if there was none."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


def cache_stat(spark: SparkSession, folder: str) -> dict[str, int]:
    """Files of a cache folder and their bytes; zeros if there is none."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        return {"entries": 0, "total_bytes": 0}
    summary = store.getContentSummary(path)
    return {"entries": int(summary.getFileCount()), "total_bytes": int(summary.getLength())}


def classify(df: DataFrame) -> DataFrame:
    """(path, format, sha256, kind, confidence, mix, route) of files by their signature, without reading their text."""
    fmt = files.signature(F.col("content"), F.col("path"))
    profile = format_profile(fmt)
    return df.select("path", fmt.alias("format"), F.sha2("content", 256).alias("sha256"), profile["kind"].alias("kind"), profile["confidence"].alias("confidence"), profile["mix"].alias("mix"), route(profile["kind"], profile["mix"], F.lit(False)).alias("route"))


def error_class(code: Column) -> Column:
    """The exit class of an error code of parsed()."""
    return F.when(code.isNull(), "ok").when(code.isin("unsupported", "malformed", "encrypted", "limit", "missing"), "input").otherwise("internal")


def document_json(document: Document) -> str:
    """A document as JSON; of assets only name, type, size and hash."""
    out = asdict(document)
    out["assets"] = [{"name": n, "media_type": m, "byte_length": len(b), "sha256": hashlib.sha256(b).hexdigest()} for n, m, b in document.assets]
    return json.dumps(out, ensure_ascii=False, indent=2)


def parse_bytes(data: bytes, name: str = "", options: ParseOptions | None = None) -> Document:
    return files.parse(data, name, (options or ParseOptions()).reader())


__all__ = [
    "EXIT_CODES", "PROTOCOLS", "DocumentError", "ParseOptions", "answered", "cache_clear", "cache_stat", "ingest", "only_pages", "parse_stream", "pdf_markdown", "request", "classify", "detect", "document_json", "document_markdown", "error_class", "parse", "parse_bytes", "replies_to_blocks",
]
