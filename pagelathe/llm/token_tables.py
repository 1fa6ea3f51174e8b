"""Token-id output: whole documents encoded and written as sorted-string-table shards, and read back."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.llm import files, sstable
from pagelathe.llm.common import as_long, shared_folder, table, written
from pagelathe.llm.token_memo import memo_of, slices

END_ID = 0
_MANIFEST = "path string, shard int, entries long, ids long"
_ROWS = "doc_id long, start long, n_tokens long, ids binary"


def write_tables(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Encode text of (doc_id, text, ...) and write it, in doc_id order, as one table file a task.

    Returns a manifest (path, shard, entries, ids); shard order is key order. Other columns are ignored.
    A null text is empty and gets only end_id; a null doc_id sorts first; repeated doc_ids are all kept, by
    a hash of their text. An empty table gives an empty manifest. A task that runs again writes a file of
    another name, and the manifest names only the files of tasks that ended.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-tables")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo, writer = memo_of(tokenizer_path), None
        shard = TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.sst"
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                flat, lengths = memo.encode(texts[a:b])
                ends = np.cumsum(lengths)
                if writer is None:
                    top = max(memo.vocabulary - 1, end_id)
                    writer = sstable.Writer(files.create(path), 2 if top < 1 << 16 else 4)
                for doc_id, n, end in zip(doc_ids[a:b], lengths.tolist(), ends.tolist(), strict=True):
                    writer.add(doc_id, np.append(flat[end - n : end], np.uint32(end_id)))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict(
                {"path": [path], "shard": pa.array([shard], pa.int32()), "entries": [writer.entries], "ids": [writer.ids]}
            )

    ordered = (
        docs.select(as_long("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
        .select("doc_id", "text")
    )
    return written(ordered.mapInArrow(write, _MANIFEST), "token-manifest")


def read_tables(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, crc32, ids) of every entry of the files a manifest names.

    start counts the ids of all entries before, over all files. The manifest has one row a file; that is
    all the driver sees. ids are little-endian unsigned 32-bit integers, null unless with_ids.
    """
    spark = manifest.sparkSession
    rows, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r.shard):
        rows.append((r.path, start))
        start += r.ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                with files.open_seekable(path) as source:
                    yield from _entries(sstable.Reader(source), first, with_ids)

    shards = spark.createDataFrame(rows, "path string, first long").repartition(max(1, len(rows)))
    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _entries(reader: sstable.Reader, first: int, with_ids: bool, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    held = 0
    for doc_id, ids in reader:
        data = ids.astype("<u4").tobytes()
        out.append((doc_id, first, len(ids), zlib.crc32(data), data if with_ids else None))
        first += len(ids)
        held += 50 + len(data) * with_ids
        if held >= most_bytes:
            yield _batch(out)
            out, held = [], 0
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = ("doc_id", "start", "n_tokens", "ids_crc32", "ids")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def op7_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_tables(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_tables(manifest, with_ids=False).drop("ids")
