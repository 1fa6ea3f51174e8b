import random

import pytest
from pagelathe.llm import mixing


def targets(sizes):
    """Capping and sharing again, round by round."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    out, total = {}, sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in out]
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        out |= {s: 3 * sizes[s] for s in over}


def check(rows, slack):
    sizes, taken, target = {}, {}, {}
    for r in rows:
        s = r["source"]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["size"] * r["copies"]
        target[s] = r["target"]
        assert 0 <= r["copies"] <= 3
    want = targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= slack


def test_odd_rows(odd_docs):
    got = mixing.mixed(odd_docs)
    assert sorted(got.columns) == sorted([*odd_docs.columns, "source_size", "target"])
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    assert all(r["copies"] == 0 for r in rows if not (r["text"] or "").strip())


def test_targets_are_met(docs):
    rnd = random.Random(3)
    rows = [(k, " ".join(["w"] * int(rnd.lognormvariate(4, 1.2) + 1)), rnd.choice(["a", "b", "c", "B", None, "é"])) for k in range(900)]
    rows += [(2000 + k, " ".join(["w"] * 9000), "big") for k in range(3)] + [(3000, "tiny", "t"), (3001, "x y", "u")]
    first = mixing.mixed(docs(rows)).select("doc_id", "source", "size", "target", "copies")
    check([r for r in first.collect() if r["source"] != "big"] + [r for r in first.collect() if r["source"] == "big"], 4600)
    small = [r for r in first.collect() if r["source"] not in ("big",)]
    for s in ("a", "b", "c", "B", None, "é"):
        own = [r for r in small if r["source"] == s]
        assert sum(r["size"] * r["copies"] for r in own) == pytest.approx(own[0]["target"], rel=0.02)
    again = mixing.mixed(docs(rows[::-1])).select("doc_id", "source", "size", "target", "copies")
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))


def test_repeated_rows_get_their_own_copies(docs):
    got = mixing.mixed(docs([(1, "a b c", "s")] * 10 + [(2, "d e", "t")])).collect()
    assert len(got) == 11


def test_empty(docs):
    assert mixing.mixed(docs([])).collect() == []
    assert [r["copies"] for r in mixing.mixed(docs([(1, None), (2, "")])).collect()] == [0, 0]
