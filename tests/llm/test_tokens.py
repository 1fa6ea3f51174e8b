import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pagelathe.llm import packing, token_tables
from pagelathe.llm import token_memo as M
from pagelathe.llm.files import create, open_seekable
from pagelathe.llm.sstable import Reader, Writer
from tokenizers import Tokenizer

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@cache
def plain(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'sÉß 世\n\t  ́.,!1290<|endoftext|>Σς-_"), max_size=40), max_size=5))
def test_memo_equals_whole_texts(path, texts):
    flat, lengths = M.memo_of(path).encode(texts)
    assert lengths.tolist() == [len(plain(path)(t)) for t in texts]
    assert flat.tolist() == [i for t in texts for i in plain(path)(t)]


def test_memo_cuts_at_words():
    assert M.memo_of(BYTE).cut is M._before_blank and M.memo_of(WORD).cut is M._at_blanks


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_special_tokens_in_texts(path):
    """They get their ids, as by the library's plain call; the pieces around them are learnt before and after."""
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b <|startoftext|> c", None, "", "hello world <|endoftext", "x  <|endoftext|>\n y"]
    flat, lengths = M.TokenMemo(path).encode(texts)
    assert flat.tolist() == [i for t in texts for i in plain(path)(t)]
    assert lengths.tolist() == [len(plain(path)(t)) for t in texts]
    assert Tokenizer.from_file(path).token_to_id("<|endoftext|>") in flat


def test_memo_of_stored_texts(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for path in (BYTE, WORD):
        memo, encode = M.TokenMemo(path), plain(path)
        for a in range(0, len(texts), 37):
            flat, lengths = memo.encode(texts[a : a + 37])
            assert flat.tolist() == [i for t in texts[a : a + 37] for i in encode(t)]


def test_memo_survives_emptying():
    memo = M.TokenMemo(BYTE, most_pieces=3)
    for text in ("one two three four five", "six seven one two"):
        assert memo.encode([text])[0].tolist() == plain(BYTE)(text)


def test_table_round_trip(tmp_path):
    path = f"file://{tmp_path}/a/b.sst"
    rows = [(None, np.arange(3)), *((k * 3 - 50, np.arange(k % 40)) for k in range(500))]
    w = Writer(create(path), 4, block_bytes=300)
    for key, ids in rows:
        w.add(key, ids)
    w.close()
    with open_seekable(path) as f:
        r = Reader(f)
        assert len(r.blocks) > 10
        assert [(k, v.tolist()) for k, v in r] == [(k, v.tolist()) for k, v in rows]
        assert r.get(-50 + 3 * 77).tolist() == list(range(77 % 40)) and r.get(None).tolist() == [0, 1, 2]
        assert r.get(-49) is None and r.get(10**12) is None
    with pytest.raises(ValueError):
        w2 = Writer(create(f"file://{tmp_path}/c.sst"), 2)
        w2.add(2, np.arange(1))
        w2.add(1, np.arange(1))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_tables_of_odd_rows(odd_docs):
    got = token_tables.read_tables(token_tables.write_tables(odd_docs, BYTE)).collect()
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, crc([*plain(BYTE)(r["text"]), 0])) for r in odd_docs.collect())
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids_crc32"]) for r in got) == want
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]
    ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert ids == sorted(ids) and got[0]["doc_id"] is None
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)


def test_empty_tables(docs):
    assert token_tables.read_tables(token_tables.write_tables(docs([]), BYTE)).collect() == []
    assert packing.pack(docs([]), WORD)[1].collect() == []


def test_packing_of_odd_rows(odd_docs):
    pieces, placed = packing.pack(odd_docs, WORD, size=64)
    got = placed.collect()
    want = sorted(len(plain(WORD)(r["text"])) + 1 for r in odd_docs.collect())
    assert sorted(r["doc_tokens"] for r in got if r["start"] == 0) == want
    assert sum(r["length"] for r in got) == sum(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(want) / (64 * len(sequences)) > 0.9
    assert {(r["doc_id"], r["start"], zlib.crc32(r["ids"])) for r in pieces.collect()} == {(r["doc_id"], r["start"], r["ids_crc32"]) for r in got}


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 1000), max_size=20))
def test_patterns_hold_the_histogram(histogram):
    left = dict(histogram)
    for count, lengths in packing.packing_patterns(histogram, 64):
        assert count > 0 and sum(lengths) <= 64
        for n in lengths:
            left[n] -= count
    assert not any(left.values())
