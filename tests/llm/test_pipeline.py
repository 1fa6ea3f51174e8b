import zlib

import brute
import corpus_pipeline as C
import numpy as np
import public_tokenizers
from pagelathe.llm import packing
from test_tokens import plain

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["quality classifier", "n-gram Jaccard join", "mixing sources", "packing"]
    kept = []
    for k, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, SF)
        if k < 3:
            assert out.columns == C.DOCUMENTS
        out.write.parquet(f"{tmp_path}/{k}")
        kept.append(docs := spark.read.parquet(f"{tmp_path}/{k}"))
    good, single, mixed, packed = ([r for r in d.collect()] for d in kept)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r["doc_id"] for r in good}
    assert all((i in ids) == bool(y) for i, y in labels.items()) or sum((i in ids) == bool(y) for i, y in labels.items()) >= 0.97 * len(labels)
    rows = sorted(((r["doc_id"], r["text"]) for r in good), key=lambda r: r[0])
    want = {i for i, n, c, _ in brute.ngram_join(rows, 5, 80, 100) if not n or i == c}
    assert {r["doc_id"] for r in single} == want
    words = lambda t: len((t or "").encode().split())
    assert {r["doc_id"] for r in mixed} <= want
    taken = sum(words(r["text"]) for r in mixed)
    assert abs(taken - sum(words(r["text"]) for r in single)) < 0.02 * taken
    encode = plain(public_tokenizers.path("word_bpe_49k.json"))
    want_pieces = []
    for r in mixed:
        ids = [*encode(r["text"]), packing.END_ID]
        want_pieces += [(r["doc_id"], a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes()), len(ids)) for a in range(0, len(ids), 2048)]
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in packed) == sorted(want_pieces)
    sequences = {}
    for r in packed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:k]) for k, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= 2048
    assert sum(r["length"] for r in packed) >= 0.97 * 2048 * len(sequences)


def single(spark, df):
    return sorted(((r["doc_id"], r["text"]) for r in C.drop_near_duplicates(spark, df, SF).collect()), key=repr)


def test_near_duplicates_of_odd_rows(spark, odd_docs):
    """One row of each component, also where ids are null or repeated; documents without words stay."""
    ids = [1, 2, 3, 4, 6, 7, 9, 11, 13, 14, 2**62, None]
    assert single(spark, odd_docs) == sorted(((r["doc_id"], r["text"]) for r in odd_docs.dropDuplicates(["doc_id", "text"]).collect() if r["doc_id"] in ids), key=repr)


def test_near_duplicates_are_decided_by_row(spark, docs):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(1, a), (None, a), (None, b), (None, b + " end"), (None, c), (2, a + " end"), (2, d), (3, d), (4, c + " x y z " + d), (None, None), (None, None), (5, "one"), (5, "one", "t"), (6, "one")]
    want = [(1, a), (None, b), (None, c), (2, d), (4, c + " x y z " + d), (None, None), (None, None), (5, "one")]
    got = single(spark, docs(rows))
    assert [x for x in got if x[1] not in (b, b + " end")] == sorted([x for x in want if x[1] != b], key=repr)
    assert sum(x[1] in (b, b + " end") for x in got) == 1
