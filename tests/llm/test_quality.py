import random

import pytest
from pagelathe.llm import quality


def corpus(n, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("an ber the ing of ra tion el".split()) for _ in range(rnd.randint(1, 3)))
    rows = []
    for k in range(n):
        words = [word() for _ in range(rnd.randint(20, 120))]
        good = rnd.random() < 0.7
        if good:
            text = ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, len(words), 9)) + "."
        else:
            text = rnd.choice([" ".join(w.upper() + "!!" for w in words), " ".join(w + "$$$" for w in words), " ".join(w for w in words[:6] for _ in range(12)), " | ".join(words)])
        rows.append((k, text, f"s{rnd.randrange(3) if good else rnd.randrange(2, 5)}", int(good)))
    return rows


def test_held_out_accuracy(spark, docs):
    rows = corpus(700, 1)
    labels = spark.createDataFrame([(k, y, 0) for k, _, _, y in rows[:350]], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.scored(docs([r[:3] for r in rows]), labels).collect()}
    rest = rows[350:]
    assert sum(got[k]["keep"] == bool(y) for k, _, _, y in rest) >= 0.97 * len(rest)
    assert sum(got[k]["keep"] for k, _, _, y in rest if y) >= 0.98 * sum(y for *_, y in rest)
    for r in got.values():
        assert 0 <= r["p_good"] <= 1 and 0 <= r["p_text"] <= 1 and 0 <= r["p_meta"] <= 1


def test_odd_rows(spark, odd_docs, docs):
    few = spark.createDataFrame([(5, 1, 0), (None, 0, 0), (3, None, 0), (7, 9, 1)], "doc_id long, quality int, toxic int")
    assert all(r["keep"] and r["p_good"] == 0.5 for r in quality.scored(odd_docs, few).collect())
    rows = corpus(60, 2)
    base = docs([(100 + k, t, s) for k, t, s, _ in rows])
    labels = spark.createDataFrame([(100 + k, y, 0) for k, _, _, y in rows] + [(6, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    both = odd_docs.union(base)
    assert quality.scored(both, labels).count() == both.count()
    kept = quality.kept(both, labels)
    assert kept.columns == both.columns and 0 < kept.count() <= both.count()
    assert quality.scored(docs([]), labels).collect() == []


def test_features_of_odd_texts():
    x = quality.text_features([None, "", " \n", "a", "é" * 10, "a a a a"])
    assert x.shape == (6, quality.TEXT_FEATURES) and not x[:3].any() and x[5].any()


@pytest.mark.parametrize("k", [1, 5])
def test_surest_are_the_surest(spark, monkeypatch, k):
    monkeypatch.setattr(quality, "PSEUDO", k)
    rows = [(i, i, bytearray(b"x"), [1], float(v), -float(v)) for i, v in enumerate([9, 3, 7, 0, -9, 7.05, 8])]
    df = spark.createDataFrame(rows, "doc_id long, tie long, text_view binary, slots array<int>, a double, b double")
    levels = quality._levels(df)
    got = quality._surest(df.withColumn("slots", df["slots"]), levels, "a", 1, 0)
    assert len(got) == min(k, 5)
    assert len(quality._surest(df, levels, "b", 1, 0)) == 1


def test_surest_of_a_crowded_level(spark, monkeypatch):
    """All rows lie in one level; those found are the surest all the same, equal rows as often as they stand."""
    monkeypatch.setattr(quality, "PSEUDO", 5)
    rows = [(None if i == 7 else i, i, bytearray(str(i).encode()), [i], 40 + (i * 37 % 400) / 1000, -9.0) for i in range(400)]
    df = spark.createDataFrame([*rows, max(rows, key=lambda r: r[4])], "doc_id long, tie long, text_view binary, slots array<int>, a double, b double")
    got = [bytes(r["text_view"]) for r in quality._surest(df, quality._levels(df), "a", 1, 0)]
    want = sorted(df.collect(), key=lambda r: -r["a"])[:5]
    assert got == [bytes(r["text_view"]) for r in want] and got[0] == got[1]


def test_views_on_stored_documents(spark):
    """Half of the labels is hidden: each view by itself, and both together, must find it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = sorted((r["doc_id"], r["quality"]) for r in labels.collect())
    shown = spark.createDataFrame([(i, y, 0) for i, y in rows[::2]], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.scored(docs, shown).collect()}
    hidden = [(got[i], y) for i, y in rows[1::2] if i in got]
    right = lambda p: sum((r[p] >= 0.5) == bool(y) for r, y in hidden) / len(hidden)
    assert right("p_good") >= 0.96 and right("p_text") >= 0.95 and right("p_meta") >= 0.8
    assert sum(r["keep"] for r, y in hidden if y) >= 0.98 * sum(y for _, y in hidden)


def brute_features(text):
    """The features that need no hash, word by word."""
    words = text.encode().split()
    passages = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    lines = [x for x in text.split("\n") if x.strip()]
    top = max(words.count(w) for w in set(words))
    return [
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words) - 1), len(set(words)) / len(words), top / len(words),
        1 - len(set(passages)) / len(passages) if passages else 0.0, len(set(lines)) / len(lines),
    ]


def test_features_against_brute_force():
    texts = [t for _, t, _, _ in corpus(60, 3)] + ["a b c d e a b c d e a b c d e", "x\nx\ny", "one", "w w w"]
    for x, t in zip(quality.text_features(texts), texts, strict=True):
        shapes = x[-8:]
        assert [round(float(v), 4) for v in (shapes[2], shapes[3], shapes[4], shapes[6], shapes[7])] == [round(v, 4) for v in brute_features(t)]
        assert abs((x[: quality.WORD_SLOTS] ** 2).sum() - 1) < 1e-4


def test_the_registered_query(spark):
    """Every document is scored, and the scores are those of the labels, as a plain count tells."""
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in quality.op1_quality(spark, sf).collect()}
    assert set(got) == {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert sum(got[i]["keep"] == bool(y) for i, y in labels.items()) >= 0.95 * len(labels)
    assert all(r["keep"] == (r["p_good"] >= quality.KEEP_FROM) for r in got.values())
