"""Main text of web pages by the recurrent block labeller."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.llm import block_lstm
from pagelathe.llm.common import as_long, table
from pagelathe.llm.html_blocks import blocks_of

#: A block is main text from this probability on.
LEAST_PROBABILITY = 0.5
_NAMES = ["page_id", "url", "text", "n_chars", "blocks", "main_blocks"]


def extracted(pages: DataFrame, weights: block_lstm.Weights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, blocks, main_blocks) of each row of pages (page_id, url, html, ...).

    text joins the blocks labelled as main text, in page order, by blanks; it is empty where there is none and for
    a null or empty html. Null ids and urls stay null, repeated rows give repeated rows, other columns are
    ignored. Pages are read whole, whatever their length.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights or block_lstm.trained())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                found = [blocks_of(x) for x in batch.column(2).to_pylist()]
                main = [np.flatnonzero(p >= LEAST_PROBABILITY) for p in block_lstm.label(shared.value, found)]
                texts = [" ".join(b[k].text for k in m) for b, m in zip(found, main, strict=True)]
                columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string())]
                columns += [pa.array([len(x) for x in c], pa.int64()) for c in (texts, found, main)]
                yield pa.RecordBatch.from_arrays(columns, _NAMES)

    read = pages.select(as_long("page_id").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return read.mapInArrow(work, "page_id long, url string, text string, n_chars long, blocks long, main_blocks long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
