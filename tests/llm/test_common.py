import random

from pagelathe.llm.common import components, ranked, written


def test_components(spark):
    rnd = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(35)] + [(-5, 900), (-5, -5)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = top(a), top(b)
        parent[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_ranks_number_each_key(spark):
    rows = [("hot", k) for k in range(3000)] + [(None, k) for k in range(5)] + [("b", 1), ("b", 1)]
    df = spark.createDataFrame(rows, "key string, id long")
    got = ranked(df, ["key"], ["id"]).collect()
    for key, n in (("hot", 3000), (None, 5), ("b", 2)):
        assert sorted(r["rank"] for r in got if r["key"] == key) == list(range(n))
    again = ranked(df.orderBy("id", ascending=False), ["key"], ["id"]).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_written_tables_keep_types(spark):
    df = spark.createDataFrame([(1, [1, None], None)], "a int, b array<int>, c string")
    assert written(df, "test").collect() == df.collect()
