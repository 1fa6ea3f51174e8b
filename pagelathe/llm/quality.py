"""Quality by co-training: a text view and a metadata view teach each other, then are calibrated and combined.

The text view sees what a document says and how it is written: its words and word pairs, hashed, the shares of kinds
of characters that follow each other, and how much of its words, passages and lines repeats. The metadata view sees
language, source and length. Each is a logistic regression. In every round both score all documents, the most
confident of each view become labels for the other, and both are fitted again. Calibration and the final weights come
from labelled rows that took no part in fitting, the accuracy from others that took part in neither.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.llm.common import as_long, scratch, table, written
from pagelathe.llm.shingles import mix, word_hashes

#: Labelled rows that are used: those with the smallest hash of their doc_id.
LABELLED = 20_000
#: Of so many of these in a row and of one class, two calibrate and one measures the accuracy; the others fit.
HELD_OUT = 10
ROUNDS = 3
#: Pseudo-labels that each view gives the other in a round, for each class; the most confident of all documents.
PSEUDO = 500
LEAST_CONFIDENCE = 0.95
#: A document with a lower combined probability of good quality is rejected.
KEEP_FROM = 0.5

WORD_SLOTS = PAIR_SLOTS = 128
_KINDS, _SHAPES, _PASSAGE = 8, 8, 5
TEXT_FEATURES = WORD_SLOTS + PAIR_SLOTS + _KINDS * _KINDS + _SHAPES
#: Ridge on the weights of hashed words and pairs, of how a text is written, and of the metadata.
WORD_RIDGE, SHAPE_RIDGE, META_RIDGE = 100.0, 1.0, 3.0
META_SLOTS = 64

_KIND = np.full(256, 6, np.uint8)  # other ASCII punctuation
_KIND[[*range(ord("a"), ord("z") + 1)]] = 0
_KIND[[*range(ord("A"), ord("Z") + 1)]] = 1
_KIND[[*range(ord("0"), ord("9") + 1)]] = 2
_KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 3
_KIND[0x0A] = 4
_KIND[[ord(c) for c in ".,;:'?-\""]] = 5
_KIND[128:] = 7


def _hashed(doc: np.ndarray, hashes: np.ndarray, docs: int, slots: int) -> np.ndarray:
    """(docs, slots): logarithms of how often the hashes of each document fall into a slot, each row of length 1."""
    slot = (hashes >> np.uint64(32)).astype(np.int64) % slots
    out = np.log1p(np.bincount(doc * slots + slot, minlength=docs * slots).reshape(docs, slots))
    return out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-9)


def text_features(texts: list[str | None]) -> np.ndarray:
    """(texts, TEXT_FEATURES) from whole texts; a text without words has zeros."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out = np.zeros((len(texts), TEXT_FEATURES), np.float32)
    words, counts = word_hashes(data)
    doc = np.repeat(np.arange(len(texts)), counts)
    pairs = mix(words[:-1] * np.uint64(3) + words[1:])
    same = doc[:-1] == doc[1:]
    out[:, :WORD_SLOTS] = _hashed(doc, words, len(texts), WORD_SLOTS)
    out[:, WORD_SLOTS : WORD_SLOTS + PAIR_SLOTS] = _hashed(doc[:-1][same], pairs[same], len(texts), PAIR_SLOTS)
    kinds = slice(WORD_SLOTS + PAIR_SLOTS, WORD_SLOTS + PAIR_SLOTS + _KINDS * _KINDS)
    at = 0
    for k, (x, m) in enumerate(zip(data, counts.tolist(), strict=True)):
        own = words[at : at + m]
        at += m
        if not m:
            continue
        kind = _KIND[np.frombuffer(x, np.uint8)]
        follows = np.bincount(kind[:-1].astype(np.int64) * _KINDS + kind[1:], minlength=_KINDS * _KINDS)
        n = len(kind)
        out[k, kinds] = np.sqrt(follows / max(1, n - 1))
        full = [y for y in x.split(b"\n") if y.strip()]
        _, times = np.unique(own, return_counts=True)
        passages = own[: max(0, m - _PASSAGE + 1)].copy()
        for j in range(1, _PASSAGE):
            passages = mix(passages + own[j : j + len(passages)])
        out[k, kinds.stop :] = [
            np.log1p(m) / 10, np.log1p(n / m) / 3, np.mean(own[1:] == own[:-1]) if m > 1 else 0.0, len(times) / m, times.max() / m,
            np.log1p(len(times)) / max(0.7, np.log1p(m)), 1 - len(np.unique(passages)) / max(1, len(passages)) if len(passages) else 0.0, len(set(full)) / max(1, len(full)),
        ]
    return out


_HASHED = WORD_SLOTS + PAIR_SLOTS


def _packed(x: np.ndarray) -> np.ndarray:
    """Rows of bytes: the hashed part, of 0 to 1, in steps of 1/255, and 16-bit floats."""
    return np.concatenate([np.round(x[:, :_HASHED] * 255).astype(np.uint8), x[:, _HASHED:].astype("<f2").view(np.uint8)], 1)


def _unpacked(rows: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    return np.concatenate([raw[:, :_HASHED].astype(np.float32) / 255, np.ascontiguousarray(raw[:, _HASHED:]).view("<f2").astype(np.float32)], 1)


def meta_features(frame: DataFrame) -> DataFrame:
    """frame with slots: hashed indicators of language, source and the binary logarithm of the length."""
    length = F.floor(F.log2(F.coalesce(F.char_length("text"), F.lit(0)) + 1))
    slot = lambda name, value: F.pmod(F.xxhash64(F.lit(name), F.coalesce(value.cast("string"), F.lit("(null)"))), F.lit(META_SLOTS)).cast("int")
    return frame.withColumn("slots", F.array(slot("lang", F.col("lang")), slot("source", F.col("source")), slot("length", length)))


def _meta_matrix(slots: np.ndarray) -> np.ndarray:
    out = np.zeros((len(slots), META_SLOTS), np.float32)
    for c in range(slots.shape[1]):
        out[np.arange(len(slots)), slots[:, c]] += 1
    return out


@dataclass
class View:
    """Standardised logistic regression with a calibrating slope and offset on its log-odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (((x - self.mean) / self.scale) @ self.weights + self.bias) + self.offset


def _newton(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weighted logistic regression with a ridge on every weight, hardly any on the bias."""
    a = np.concatenate([x, np.ones((len(x), 1))], 1).astype(np.float64)
    theta, keep = np.zeros(a.shape[1]), np.append(ridge, 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        grad = a.T @ (w * (p - y)) + keep * theta
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag(keep)
        step = np.linalg.solve(hess + 1e-9 * np.eye(len(hess)), grad)
        theta -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return theta[:-1], float(theta[-1])


def _fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: np.ndarray) -> View:
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale < 1e-6, 1.0, scale)
    # both classes weigh the same, so that a view learns what they look like, not how common they are
    balance = np.where(y > 0, 0.5 / max(1e-9, (w * y).sum()), 0.5 / max(1e-9, (w * (1 - y)).sum())) * w.sum()
    weights, bias = _newton((x - mean) / scale, y, w * balance, ridge)
    return View(mean, scale, weights, bias)


def _calibrate(view: View, x: np.ndarray, y: np.ndarray) -> None:
    """Platt's slope and offset on held-out rows."""
    slope, offset = _newton(view.log_odds(x)[:, None], (y * (y.sum() + 1) / (y.sum() + 2) + (1 - y) / ((1 - y).sum() + 2)), np.ones(len(y)), np.full(1, 1e-3))
    view.slope, view.offset = max(0.0, float(slope[0])), offset


@dataclass
class Model:
    text: View
    meta: View
    prior: float
    #: Of held_out labelled rows that neither fitted nor calibrated.
    accuracy: float
    held_out: int

    def log_odds(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.log_odds(text), self.meta.log_odds(meta)
        return a, b, a + b - self.prior


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, text_view, slots) of all documents, as a written table; text_view is as _packed() has it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                x = text_features(batch.column(2).to_pylist())
                packed = pa.array([r.tobytes() for r in _packed(x)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, batch.column(3)], ["doc_id", "tie", "text_view", "slots"])

    read = docs.select(
        as_long("doc_id").alias("doc_id"), F.xxhash64("text", "lang", "source").alias("tie"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")
    )
    read = meta_features(read).select("doc_id", "tie", "text", "slots")
    return written(read.mapInArrow(work, "doc_id long, tie long, text_view binary, slots array<int>"), "quality-views", compression="zstd")


def _views(rows: list) -> tuple[np.ndarray, np.ndarray]:
    text = _unpacked([r["text_view"] for r in rows])
    return text, _meta_matrix(np.array([r["slots"] for r in rows], np.int64).reshape(len(rows), -1))


def _scored(views: DataFrame, model: Model) -> DataFrame:
    """views with log-odds a of the text view, b of the metadata view and both together, for all documents."""
    shared = views.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                text = _unpacked(batch.column(2).to_pylist())
                slots = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(text), -1)
                scores = shared.value.log_odds(text, _meta_matrix(slots))
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(s.astype(np.float64)) for s in scores)], [*batch.schema.names, "a", "b", "both"])

    return views.mapInArrow(work, "doc_id long, tie long, text_view binary, slots array<int>, a double, b double, both double")


_LEVEL, _MOST_LEVEL = 8, 240


def _level(column: str, sign: int) -> Column:
    return F.least(F.lit(_MOST_LEVEL), F.floor(F.col(column) * (sign * _LEVEL))).cast("int")


def _levels(scored: DataFrame) -> dict[tuple[str, int], dict[int, int]]:
    """How many of all documents each view is sure of, by (view, class) and level of log-odds: under 1000 numbers."""
    bar = float(np.log(LEAST_CONFIDENCE / (1 - LEAST_CONFIDENCE)))
    kinds = [(c, s) for c in "ab" for s in (1, -1)]
    marks = F.array(*[F.when(F.col(c) * s >= bar, F.struct(F.lit(c).alias("view"), F.lit(s).alias("sign"), _level(c, s).alias("level"))) for c, s in kinds])
    out: dict[tuple[str, int], dict[int, int]] = {k: {} for k in kinds}
    for r in scored.select(F.explode(F.array_compact(marks)).alias("m")).groupBy("m.view", "m.sign", "m.level").count().collect():
        out[r["view"], r["sign"]][r["level"]] = r["count"]
    return out


def _surest(scored: DataFrame, levels: dict, column: str, sign: int, salt: int) -> list:
    """The PSEUDO documents that a view is surest of. What is sorted is no more than their levels hold; where those are
    crowded, narrow rows are, and only the views of the rows found are fetched, one for all rows of a (doc_id, tie)."""
    counts, total, last = levels[column, sign], 0, None
    for level in sorted(counts, reverse=True):
        total, last = total + counts[level], level
        if total >= PSEUDO:
            break
    if last is None:
        return []
    bar = float(np.log(LEAST_CONFIDENCE / (1 - LEAST_CONFIDENCE)))
    some = scored.where((F.col(column) * sign >= bar) & (_level(column, sign) >= last))
    first = some.orderBy((F.col(column) * sign).desc(), F.xxhash64("doc_id", F.lit(salt)), "doc_id", "tie").limit(PSEUDO)
    if total <= 20 * PSEUDO:
        return first.select("text_view", "slots").collect()
    order = [(r["doc_id"], r["tie"]) for r in first.select("doc_id", "tie").collect()]
    keys = scored.sparkSession.createDataFrame(list(dict.fromkeys(order)), "_id long, _tie long")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("tie").eqNullSafe(F.col("_tie"))
    views = scored.join(F.broadcast(keys), same).groupBy("_id", "_tie").agg(F.first(F.struct("text_view", "slots")).alias("v")).collect()
    found = {(r["_id"], r["_tie"]): r["v"] for r in views}
    return [found[k] for k in order]


def co_train(views: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on labels (doc_id, quality 0 or 1); None if either class has fewer than 4 labelled documents.

    The sample of labelled rows is bounded by LABELLED; the pseudo-labels of a round, by 4 * PSEUDO, are the most
    confident of all documents. Labels that are null or neither 0 nor 1 are ignored; of a doc_id labelled
    twice the lower label counts, of a doc_id that several documents have, one document.
    """
    given = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(as_long("doc_id").alias("id")).agg(F.min("quality").alias("quality"))
    joined = views.join(given, F.col("doc_id") == F.col("id")).drop("id")
    # a hash keeps about 1.2 * LABELLED rows, so that no more is sorted or sent; the limit then is exact
    share = min(1.0, 1.2 * LABELLED / max(1, joined.count()))
    picked = joined.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = picked.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", "tie").limit(LABELLED).collect()
    rows = list({r["doc_id"]: r for r in rows}.values())
    y = np.array([r["quality"] for r in rows], np.float64)
    if y.sum() < 4 or (1 - y).sum() < 4:
        return None
    text, meta = _views(rows)
    # each row has one use
    held, measured = np.zeros(len(y), np.bool_), np.zeros(len(y), np.bool_)
    for c in (0, 1):
        own = np.flatnonzero(y == c)
        held[own[::HELD_OUT]] = held[own[3::HELD_OUT]] = measured[own[1::HELD_OUT]] = True
    fits = ~held & ~measured
    prior = float(np.log(y.mean() / (1 - y.mean())))
    more: dict[str, tuple[np.ndarray, np.ndarray]] = {"text": (text[:0], y[:0]), "meta": (meta[:0], y[:0])}
    model = None
    text_ridge = np.where(np.arange(TEXT_FEATURES) < WORD_SLOTS + PAIR_SLOTS, WORD_RIDGE, SHAPE_RIDGE)
    for k in range(ROUNDS + 1):
        fitted = {}
        for name, x, ridge in (("text", text, text_ridge), ("meta", meta, np.full(META_SLOTS, META_RIDGE))):
            px, py = more[name]
            weight = np.concatenate([np.ones(fits.sum()), np.full(len(py), 0.5)])
            fitted[name] = _fit(np.concatenate([x[fits], px]), np.concatenate([y[fits], py]), weight, ridge)
            _calibrate(fitted[name], x[held], y[held])
        model = Model(fitted["text"], fitted["meta"], prior, 0.0, int(measured.sum()))
        if k == ROUNDS:
            break
        scored = _scored(views, model)
        levels = _levels(scored)
        for teacher, pupil, column in (("text", "meta", "a"), ("meta", "text", "b")):
            picked = []
            for sign, label in ((1, 1.0), (-1, 0.0)):
                picked += [(r, label) for r in _surest(scored, levels, column, sign, k)]
            if picked:
                t, m = _views([r for r, _ in picked])
                labels_now = np.array([v for _, v in picked])
                old_x, old_y = more[pupil]
                more[pupil] = np.concatenate([old_x, t if pupil == "text" else m]), np.concatenate([old_y, labels_now])
    both = model.log_odds(text[measured], meta[measured])[2]
    model.accuracy = float(np.mean((both >= 0) == (y[measured] > 0)))
    return model


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, tie, p_text, p_meta, p_good, keep) of every row of docs (doc_id, text, lang, source, ...).

    tie is a hash of text, lang and source, by which rows of one doc_id are told apart. Null values count as a
    value of their own; empty texts have the zero vector. With too few labels every row is kept, at 0.5. Other
    columns are ignored; an empty table gives an empty one.
    """
    views = featured(docs)
    model = co_train(views, labels)
    if model is None:
        return views.select("doc_id", "tie", *[F.lit(0.5).alias(c) for c in ("p_text", "p_meta", "p_good")], F.lit(True).alias("keep"))
    p = lambda c: 1 / (1 + F.exp(-F.col(c)))
    return _scored(views, model).select("doc_id", "tie", p("a").alias("p_text"), p("b").alias("p_meta"), p("both").alias("p_good"), (p("both") >= KEEP_FROM).alias("keep"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, all columns as they were."""
    # equal (doc_id, tie) are equal rows as far as scoring goes, so they stand or fall together
    with scratch(docs.sparkSession) as tables:
        verdict = scored(docs, labels).where("NOT keep").select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).distinct()
        rejected = tables.keep(written(verdict, "rejected"))
    same = as_long("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text", "lang", "source") == F.col("_tie"))
    return docs.join(rejected, same, "left_anti")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("tie")
