"""Document fingerprints: digests of improbable byte windows in chained Bloom filters (after Roussev, 2010).

Every window of WINDOW bytes has an entropy. Windows whose entropy lies far from that of ordinary text are rare,
and a window that is the rarest in enough of the stretches around it is a feature. Features enter Bloom filters of
2048 bits, 160 to a filter. Two digests are as like as their filters' common bits exceed chance.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.llm.common import as_long, shuffle_partitions, table
from pagelathe.llm.shingles import _BYTE, _tables, mix

WINDOW = 24
#: A window is a feature if it is the rarest in POPULAR of the STRETCH stretches, of STRETCH windows each, that hold it.
STRETCH, POPULAR = 16, 4
#: In thousandths of the greatest entropy: that of ordinary text, and below which a window is mere repetition.
TYPICAL, DEGENERATE = 740, 100
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
#: A text with fewer features than FEW also gets its windows of SMALL bytes, rare or not.
FEW, SMALL = 8, 8
_GAP, _SEGMENT, _MARGIN = 192, 1 << 18, 192

_scaled = np.zeros(WINDOW + 2, np.int64)
_scaled[1:] = np.round(np.arange(1, WINDOW + 2) * np.log2(np.arange(1, WINDOW + 2)) * (1 << 16)).astype(np.int64)
_FULL = int(_scaled[WINDOW])
_NEVER = np.int64(1) << 40


def _entropy(b: np.ndarray) -> np.ndarray:
    """Thousandths of the greatest entropy for each window of b, updated from window to window in integers."""
    n = len(b)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = (b[d:] == b[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    first = int(_scaled[np.bincount(b[:WINDOW], minlength=256)].sum())
    leave = after[: n - WINDOW] + 1  # of the byte that leaves, within the window
    enter = before[WINDOW:]  # of the byte that enters, within the WINDOW - 1 before
    gain = (_scaled[1:] - _scaled[:-1])[enter] - (_scaled[1:] - _scaled[:-1])[leave - 1]
    total = np.concatenate([[first], first + np.cumsum(gain)])
    return (_FULL - total) * 1000 // _FULL


def _features(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, place in it, hash) of the features of byte strings; places in order."""
    sizes = np.array([len(p) for p in pieces])
    starts = np.concatenate([[0], np.cumsum(sizes + _GAP)[:-1]])
    buffer = b"".join(x for p in pieces for x in (p, bytes(_GAP)))
    b = np.frombuffer(buffer, np.uint8)
    score = _entropy(b)
    n = len(score)
    real = np.zeros(len(b) + 1, np.int32)
    windows = np.maximum(sizes - WINDOW + 1, 0)
    has = windows > 0
    real[starts[has]] += 1
    np.subtract.at(real, (starts + windows)[has], 1)
    inside = np.cumsum(real)[:n] > 0
    key = (1000 - np.abs(score - TYPICAL)).astype(np.int64)
    key = np.where(inside & (score >= DEGENERATE), key << 24 | np.arange(n), _NEVER)
    least = key.copy()
    s = 1
    while s < STRETCH:
        np.minimum(least[:-s], least[s:], out=least[:-s])
        s *= 2
    won = least[inside & (least < _NEVER)] & ((1 << 24) - 1)
    popular = np.bincount(won, minlength=n)
    at = np.flatnonzero(popular >= POPULAR)
    piece = np.searchsorted(starts, at, side="right") - 1
    without = np.setdiff1d(np.arange(len(pieces)), piece)
    if len(without):  # few windows: the most popular, the leftmost of them
        more = [int(np.argmax(popular[a : a + w])) + a for a, w in zip(starts[without], windows[without], strict=True) if w and popular[a : a + w].any()]
        at = np.sort(np.concatenate([at, np.array(more, np.int64)])).astype(np.int64)
        piece = np.searchsorted(starts, at, side="right") - 1
    powers, inverse = _tables(len(b))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * powers[: len(b)], dtype=np.uint64)])
    hashes = mix((total[at + WINDOW] - total[at]) * inverse[at])
    return piece, at - starts[piece], hashes


def _small_windows(x: bytes) -> np.ndarray:
    """The distinct windows of SMALL bytes of a whole text with few features, by first place; of a shorter text, the text.

    Such a text is short or repeats itself, so its distinct windows are few; it is read a segment at a time.
    """
    if len(x) < SMALL:
        return np.array([xxhash.xxh3_64_intdigest(x)] if x else [], np.uint64)
    parts = []
    for at in range(0, len(x) - SMALL + 1, _SEGMENT):
        b = np.frombuffer(x, np.uint8, min(_SEGMENT + SMALL - 1, len(x) - at), at).astype(np.uint64)
        n = len(b) - SMALL + 1
        value = np.zeros(n, np.uint64)
        for k in range(SMALL):
            value |= b[k : k + n] << np.uint64(8 * k)
        parts.append(_by_first_place(value))
    return mix(_by_first_place(np.concatenate(parts)))


def _by_first_place(values: np.ndarray) -> np.ndarray:
    return values[np.sort(np.unique(values, return_index=True)[1])]


class Digest:
    """The filters of one text, (filters, 256) bytes, and the number of features."""

    __slots__ = ("filters", "features", "ones")

    def __init__(self, hashes: np.ndarray) -> None:
        self.features = len(hashes)
        bits = np.zeros((-(-len(hashes) // FILTER_FEATURES), FILTER_BITS), np.bool_)
        row = np.arange(len(hashes)) // FILTER_FEATURES
        for k in range(HASHES):
            bits[row, (hashes >> np.uint64(11 * k)).astype(np.int64) & (FILTER_BITS - 1)] = True
        self.filters = np.packbits(bits, axis=1)
        self.ones = bits.sum(1)

    def __str__(self) -> str:
        return f"{self.features}:{base64.b64encode(self.filters.tobytes()).decode()}" if self.features else ""


def likeness(a: Digest, b: Digest) -> float:
    """From 0 to 1. Each filter of the shorter digest counts with its best match; bits common by chance do not."""
    if not a.features or not b.features:
        return float(a.features == b.features)
    if len(a.filters) > len(b.filters):
        a, b = b, a
    common = np.bitwise_count(a.filters[:, None, :] & b.filters[None, :, :]).sum(2, dtype=np.int64)
    chance = a.ones[:, None] * b.ones[None, :] / FILTER_BITS
    most = np.minimum(a.ones[:, None], b.ones[None, :])
    score = np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1).max(1)
    weight = np.full(len(a.filters), FILTER_FEATURES)
    weight[-1] = a.features - FILTER_FEATURES * (len(a.filters) - 1)
    return float((score * weight).sum() / weight.sum())


def digests(texts: list[str]) -> list[Digest]:
    """Digests of whole texts. Long texts are cut into overlapping segments, whose features are those of the whole."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    found: list[list[np.ndarray]] = [[] for _ in texts]
    pieces, owner = [], []
    held = 0

    def flush() -> None:
        nonlocal held
        if pieces:
            piece, place, hashes = _features(pieces)
            cut = np.searchsorted(piece, np.arange(len(pieces) + 1))
            for k, (doc, low, high) in enumerate(owner):
                s = slice(cut[k], cut[k + 1])
                core = (place[s] >= low) & (place[s] < high)
                found[doc].append(hashes[s][core])
        pieces.clear()
        owner.clear()
        held = 0

    for k, x in enumerate(data):
        for at in range(0, len(x), _SEGMENT):
            low, high = max(0, at - _MARGIN), min(len(x), at + _SEGMENT + _MARGIN)
            pieces.append(x[low:high])
            owner.append((k, at - low, at - low + _SEGMENT))
            held += high - low + _GAP
            if held >= _SEGMENT:
                flush()
    flush()
    out = []
    for x, parts in zip(data, found, strict=True):
        own = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        if len(own) < FEW:
            own = np.concatenate([own, _small_windows(x)])
        own = _by_first_place(own)
        out.append(Digest(own))
    return out


def _part_of(value: Column, bounds: list[int], first: int = 0) -> Column:
    """The number of bounds not above value, as a tree of comparisons; null counts as the least."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(value >= bounds[mid], _part_of(value, bounds[mid + 1 :], first + mid + 1)).otherwise(_part_of(value, bounds[:mid], first))


def _with_next(docs: DataFrame) -> DataFrame:
    """Partitions of (role, doc_id, text) in descending order of doc_id; role 1 marks, at the end, the row that follows.

    Ranges of doc_id are cut at quantiles. The first row of each range, one row a partition, is what the range
    above sends for; it travels twice. The last range is followed by the first row of all.
    """
    spark = docs.sparkSession
    rows = docs.select(as_long("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = shuffle_partitions(spark)
    probes = [k / parts for k in range(1, parts)]
    found = rows.select("doc_id").where("doc_id IS NOT NULL").approxQuantile("doc_id", probes, 0.25 / parts)
    bounds = sorted({int(x) for x in found})
    rows = rows.withColumn("part", _part_of(F.col("doc_id"), bounds).cast("int")).withColumn("tie", F.xxhash64("text"))
    heads = sorted((r["part"], r["h"]["doc_id"], r["h"]["tie"]) for r in rows.groupBy("part").agg(F.max(F.struct("doc_id", "tie")).alias("h")).collect())
    above = [heads[(k + 1) % len(heads)][0] for k in range(len(heads))]  # the range that each head follows
    sent = spark.createDataFrame(
        [(p, d, t, a) for (p, d, t), a in zip(heads, above, strict=True)], "_part int, _id long, _tie long, _above int"
    )
    same = (F.col("part") == F.col("_part")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("role"))
    more = F.struct(F.col("_above").alias("part"), F.lit(1).alias("role"))
    to = F.when(F.col("_above").isNull(), F.array(own)).otherwise(F.array(own, more))
    dealt = rows.join(F.broadcast(sent), same, "left").select("doc_id", "text", "tie", F.explode(to).alias("to")).select("doc_id", "text", "tie", "to.part", "to.role")
    return dealt.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("role", F.col("doc_id").desc_nulls_last(), F.col("tie").desc()).select("role", "doc_id", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def edited(text: str, following: str) -> str:
    """text, its last third replaced by the beginning of what follows."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def fingerprinted(docs: DataFrame) -> DataFrame:
    """A row of SCHEMA for each row of docs (doc_id, text, ...): fingerprints of it, of its edited text, and their likeness.

    The next document is the next smaller doc_id, after the smallest the greatest; null ids come last and rows of
    one id are ordered by a hash of their text. A sole document follows itself. Null and empty texts have
    the fingerprint '', like each other by 1 and anything else by 0. Texts with hardly any rare
    window, short or mere repetition, are digested by small windows too. Other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        known: list[Digest] = []  # of held[0], when it was looked at as a next document

        def done(rows: list[tuple], following: tuple) -> pa.RecordBatch:
            texts = [t for _, t in rows]
            after = [*texts[1:], following[1]]
            own = known + digests([*texts[len(known) :], following[1]])
            changed = [edited(t, f) for t, f in zip(texts, after, strict=True)]
            other = digests(changed)
            known[:] = own[-1:]
            out = [
                (doc_id, len(t), hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest(), str(own[k]), str(other[k]), likeness(own[k], other[k]), likeness(own[k], own[k + 1]))
                for k, ((doc_id, t), c) in enumerate(zip(rows, changed, strict=True))
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

        size, guest = 0, None
        for batch in batches:
            for role, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if role:
                    guest = guest or (doc_id, text)
                    continue
                held.append((doc_id, text))
                size += len(text)
                if size >= 500_000 and len(held) > 1:
                    yield done(held[:-1], held[-1])
                    held, size = held[-1:], len(held[-1][1])
        if held:
            yield done(held, guest)

    return _with_next(docs).mapInArrow(work, SCHEMA)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))
