import random

import brute
from pagelathe.llm import ngram_join as N


def as_rows(df):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted((tuple(r) for r in df.collect()), key=key)


def expected(df, width, num, den):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(brute.ngram_join([(r["doc_id"], r["text"]) for r in df.collect()], width, num, den), key=key)


def test_odd_rows(odd_docs):
    assert as_rows(N.ngram_join(odd_docs, 4, 85, 100)) == expected(odd_docs, 4, 85, 100)


def test_empty(docs):
    assert N.ngram_join(docs([])).collect() == []


def test_random_near_copies_with_long_columns(docs):
    """Small limits send most columns through the blocked products of groups."""
    rnd, rows = random.Random(1), []
    for g in range(4):
        base = [f"g{g}w{rnd.randrange(500)}" for _ in range(60 + 20 * g)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rnd.randrange(6)):
                copy[rnd.randrange(len(copy))] = f"e{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy[: len(copy) - rnd.randrange(8)])))
    rows += [(len(rows) + k, " ".join(f"u{rnd.randrange(10**6)}" for _ in range(30))) for k in range(30)]
    df = docs(rows)
    assert as_rows(N.ngram_join(df, 4, 85, 100, long_column=3, block=8)) == expected(df, 4, 85, 100)
    assert as_rows(N.ngram_join(df, 5, 80, 100, long_column=6, block=16)) == expected(df, 5, 80, 100)


def test_small_units(docs, monkeypatch):
    """Stars and blocks of few entries give the same links."""
    monkeypatch.setattr(N, "UNIT_ENTRIES", 100)
    rnd, rows = random.Random(5), []
    for g in range(3):
        base = [f"g{g}w{k}" for k in range(50)]
        rows += [(len(rows) + k, " ".join([*base[: 50 - rnd.randrange(5)], f"x{rnd.randrange(4)}"])) for k in range(20)]
    df = docs(rows)
    for long_column in (3, 24):
        assert as_rows(N.ngram_join(df, 4, 85, 100, long_column=long_column, block=8)) == expected(df, 4, 85, 100)


def test_words_that_polynomials_confuse(docs):
    """Thue-Morse words and their complements are told apart, whatever their length."""
    a = "a"
    while len(a) < 4096:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    df = docs([(1, a), (2, b), (3, f"x y {a}"), (4, f"x y {b}"), (5, a)])
    assert as_rows(N.ngram_join(df, 4, 85, 100)) == expected(df, 4, 85, 100)


def test_white_space_of_all_kinds(docs):
    df = docs([(1, "a\tb\x0bc\x0cd\re f"), (2, " a b c d e f\n"), (3, "a\x1cb c d e f"), (4, "a\x85b\xa0c d e f")])
    assert as_rows(N.ngram_join(df, 4, 85, 100)) == expected(df, 4, 85, 100)


def test_the_registered_query(spark):
    """The query itself, over a whole stored table, against brute force."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    assert as_rows(N.op2_ngram_join(spark, sf)) == expected(rows, 4, 85, 100)
