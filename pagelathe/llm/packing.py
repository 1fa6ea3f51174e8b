"""Packing token sequences: shortest-pack-first over the histogram of piece lengths (Krell et al., 2021)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.llm.common import as_long, ranked, table, written
from pagelathe.llm.token_memo import MOST_PIECES, memo_of, slices

SEQUENCE = 2048
END_ID = 1
#: The slots are broadcast up to so many rows of 40 bytes, else joined by a shuffle.
MOST_BROADCAST_SLOTS = 200_000


def cut_pieces(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE, end_id: int = END_ID, memo_pieces: int = MOST_PIECES) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): whole texts encoded, end_id appended, cut every size ids.

    A null text is empty and gives one piece with end_id alone. Null and repeated doc_ids and repeated rows
    each give pieces of their own. ids are little-endian unsigned 32-bit integers.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = memo_of(tokenizer_path, memo_pieces)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                flat, lengths = memo.encode(texts[a:b])
                out: list[tuple] = []
                end = 0
                for doc_id, n in zip(doc_ids[a:b], lengths.tolist(), strict=True):
                    data = np.append(flat[end : end + n], np.uint32(end_id)).astype("<u4").tobytes()
                    end += n
                    for at in range(0, n + 1, size):
                        out.append((doc_id, at, min(size, n + 1 - at), n + 1, data[4 * at : 4 * (at + size)]))
                names = ("doc_id", "start", "length", "doc_tokens", "ids")
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    read = docs.select(as_long("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids binary")


def packing_patterns(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, list[int]]]:
    """(count, lengths longest first) of the patterns that hold every length of a histogram.

    Lengths are placed longest first. Each goes to the shortest open patterns that leave it room; when a
    pattern is needed fewer times than it stands, it is split. Work and patterns depend on size alone, not
    on the counts.
    """
    open_packs: list[list] = []  # heap of (used, age, count, lengths)
    full: list[tuple[int, list[int]]] = []
    age = 0

    def keep(count: int, lengths: list[int], used: int) -> None:
        nonlocal age
        if used == size:
            full.append((count, lengths))
        else:
            age += 1
            heapq.heappush(open_packs, [used, age, count, lengths])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not open_packs or open_packs[0][0] + length > size:
                # several of one length share a new pattern
                fit = min(size // length, left)
                keep(left // fit, [length] * fit, fit * length)
                left -= left // fit * fit
                continue
            used, _, count, lengths = heapq.heappop(open_packs)
            fit = min((size - used) // length, max(1, left // count))
            times = min(count, left // fit)
            keep(times, [*lengths, *[length] * fit], used + fit * length)
            if count > times:
                keep(count - times, lengths, used)
            left -= times * fit
    return full + [(count, lengths) for _, _, count, lengths in sorted(open_packs, key=lambda x: x[:2])]


def _slots(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces of the length in the pattern, offset there)."""
    placed: dict[int, int] = {}
    out, sequence = [], 0
    for count, lengths in patterns:
        at = k = 0
        while k < len(lengths):
            length, same = lengths[k], 1
            while k + same < len(lengths) and lengths[k + same] == length:
                same += 1
            first = placed.get(length, 0)
            placed[length] = first + count * same
            out.append((length, first, first + count * same, sequence, same, at))
            at += same * length
            k += same
        sequence += count
    return out


def assign(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """pieces with sequence_id and offset.

    Only the histogram, of at most size rows, reaches the driver. Pieces find their pattern by their rank
    among those of their length. Sequences are numbered from 0; a sequence holds one pattern, and all
    of it but the gap at its end is filled.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = _slots(packing_patterns(histogram, size))
    lookup = spark.createDataFrame(slots or [(0, 0, 0, 0, 1, 0)], "_length long, _lo long, _hi long, _sequence long, _same long, _offset long")
    if len(slots) <= MOST_BROADCAST_SLOTS:
        lookup = F.broadcast(lookup)
    nth = F.col("_rank") - F.col("_lo")
    return (
        ranked(pieces, ["length"], ["doc_id", "start"], "_rank")
        .join(lookup, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
        .withColumn("sequence_id", (F.col("_sequence") + F.floor(nth / F.col("_same"))).cast("long"))
        .withColumn("offset", (F.col("_offset") + nth % F.col("_same") * F.col("length")).cast("long"))
        .drop("_rank", "_length", "_lo", "_hi", "_sequence", "_same", "_offset")
    )


def pack(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE, end_id: int = END_ID, memo_pieces: int = MOST_PIECES) -> tuple[DataFrame, DataFrame]:
    """(pieces, placement): the pieces with their ids as a written table, and where each lies.

    Of docs only doc_id and text count. An empty table gives two empty ones. memo_pieces bounds what a worker remembers of
    the tokenizer's work; the result does not depend on it.
    """
    pieces = written(cut_pieces(docs, tokenizer_path, size, end_id, memo_pieces), "pieces", compression="zstd")
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pieces, assign(digests, size)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    _, placement = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return placement
