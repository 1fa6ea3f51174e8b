import base64
import hashlib
import random
from collections import Counter
from math import log2

import numpy as np
from pagelathe.llm import fingerprints as P


def test_entropy_is_that_of_each_window():
    rnd = random.Random(1)
    b = np.frombuffer(bytes(rnd.choice(b"abcdefgh ") for _ in range(400)), np.uint8)
    got = P._entropy(b)
    assert len(got) == len(b) - P.WINDOW + 1
    for k, v in enumerate(got):
        h = -sum(n / P.WINDOW * log2(n / P.WINDOW) for n in Counter(b[k : k + P.WINDOW].tolist()).values())
        assert abs(v - h / log2(P.WINDOW) * 1000) <= 1.01


def test_long_texts_do_not_depend_on_segments(monkeypatch):
    rnd = random.Random(2)
    text = "".join(rnd.choice("abcdefghij kl\n") for _ in range(70_000))
    whole = str(P.digests([text])[0])
    monkeypatch.setattr(P, "_SEGMENT", 1 << 12)
    assert str(P.digests(["x", text, ""])[1]) == whole


def test_likeness():
    a, b, empty, same = P.digests(["some text " * 3 + str(list(range(300))), "quite another one " + str(list(range(900, 1200))), "", "some text " * 3 + str(list(range(300)))])
    assert P.likeness(a, a) == P.likeness(a, same) == 1 and P.likeness(empty, empty) == 1 and P.likeness(a, empty) == 0
    assert P.likeness(a, b) < 0.3 and P.likeness(a, b) == P.likeness(b, a)


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        e = P.edited(t, after)
        x, y, z = (P.digests([v])[0] for v in (t, e, after))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), str(x), str(y), P.likeness(x, y), P.likeness(x, z)))
    return out


def test_against_brute_force(docs):
    rnd = random.Random(3)
    rows = [(k * 7 % 101 - 20, " ".join(rnd.choice("alpha beta gamma 世界 été".split()) + str(rnd.randrange(50)) for _ in range(rnd.randrange(200)))) for k in range(60)] + [(500, None), (501, "z" * 40_000), (502, "")]
    got = [tuple(r) for r in P.fingerprinted(docs(rows)).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_odd_rows(odd_docs, docs):
    rows = P.fingerprinted(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_text = {}
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text.setdefault((r["doc_id"], r["n_chars"]), set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    (one,) = P.fingerprinted(docs([(4, "only one document here")])).collect()
    assert one["near_next"] == 1.0
    assert P.fingerprinted(docs([])).collect() == []


def plain_places(x):
    """Places of the features of one byte string, window by window."""
    scaled = [0] + [round(c * log2(c) * 65536) for c in range(1, P.WINDOW + 1)]
    windows = [x[k : k + P.WINDOW] for k in range(len(x) - P.WINDOW + 1)]
    scores = [(scaled[P.WINDOW] - sum(scaled[n] for n in Counter(w).values())) * 1000 // scaled[P.WINDOW] for w in windows]
    wins = Counter()
    for k in range(len(windows)):
        near = [(1000 - abs(scores[j] - P.TYPICAL), j) for j in range(k, min(k + P.STRETCH, len(windows))) if scores[j] >= P.DEGENERATE]
        if near:
            wins[min(near)[1]] += 1
    places = sorted(k for k, n in wins.items() if n >= P.POPULAR)
    return places or ([min(wins, key=lambda k: (-wins[k], k))] if wins else [])


def plain_likeness(a, b):
    """The same from two fingerprints as they are written, bit by bit."""
    if not a or not b:
        return float(a == b)
    (n, x), (m, y) = ((int(s.partition(":")[0]), base64.b64decode(s.partition(":")[2])) for s in (a, b))
    filters = [[int.from_bytes(s[k : k + P.FILTER_BITS // 8], "big") for k in range(0, len(s), P.FILTER_BITS // 8)] for s in (x, y)]
    if len(filters[0]) > len(filters[1]):
        filters, n = filters[::-1], m
    score = weight = 0.0
    for k, f in enumerate(filters[0]):
        best = 0.0
        for g in filters[1]:
            chance = f.bit_count() * g.bit_count() / P.FILTER_BITS
            best = max(best, ((f & g).bit_count() - chance) / max(min(f.bit_count(), g.bit_count()) - chance, 1e-9))
        own = P.FILTER_FEATURES if k < len(filters[0]) - 1 else n - P.FILTER_FEATURES * k
        score, weight = score + min(1.0, best) * own, weight + own
    return score / weight


def test_features_and_likeness_against_plain_code():
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("abcdefg hij\n") for _ in range(rnd.randrange(24, 900))) for _ in range(30)] + ["ab" * 200, "x" * 300, "short"]
    for t in texts:
        piece, place, _ = P._features([t.encode()])
        assert place.tolist() == plain_places(t.encode()) and not piece.any()
    found = [str(d) for d in P.digests([*texts, texts[0][:-100] + texts[1], ""])]
    for a, b in zip(P.digests(texts), P.digests([*texts[1:], texts[0]]), strict=True):
        assert abs(P.likeness(a, b) - plain_likeness(str(a), str(b))) < 1e-9
    assert 0 < plain_likeness(found[0], found[-2]) <= 1 and plain_likeness(found[0], found[0]) == 1 and plain_likeness(found[0], found[-1]) == 0


def test_long_texts_of_few_features_are_read_whole(monkeypatch):
    """Two texts of one period that differ far behind their first windows have different fingerprints."""
    a, b = "ab" * 20_000, "ab" * 15_000 + "cdcdcdcd" + "ab" * 4_996
    one, two = P.digests([a, b])
    assert str(one) != str(two) and two.features > one.features
    monkeypatch.setattr(P, "_SEGMENT", 1 << 10)
    assert [str(d) for d in P.digests([a])] == [str(one)]


def test_the_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in P.op8_fingerprints(spark, sf).collect()}
    order = sorted(rows, key=lambda r: r[0], reverse=True)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        changed = t[: len(t) - cut] + after[:cut]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert abs(got[i]["near_edited"] - plain_likeness(got[i]["fingerprint"], got[i]["edited_fingerprint"])) < 1e-9
        assert abs(got[i]["near_next"] - plain_likeness(got[i]["fingerprint"], got[order[(k + 1) % len(order)][0]]["fingerprint"])) < 1e-9
