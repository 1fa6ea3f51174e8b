"""Every registered query of the library against its SQL on the smallest tables; the rest gives rows."""

import duckdb
import pytest
from pagelathe import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck, tmp_path):
    out = str(tmp_path / "out")
    registry.QUERIES[name](spark, SF).write.parquet(out)
    got = f"SELECT * FROM '{out}/*.parquet'"
    rows = duck.execute(f"SELECT count(*) FROM ({got})").fetchone()[0]
    assert rows > 0
    if name in registry.ORACLE_SQL:
        sql = registry.ORACLE_SQL[name]
        columns = sorted(r[0] for r in duck.execute(f"DESCRIBE {sql}").fetchall())
        assert columns == sorted(r[0] for r in duck.execute(f"DESCRIBE {got}").fetchall())
        names = ", ".join(f'"{c}"' for c in columns)
        for a, b in ((got, sql), (sql, got)):
            assert duck.execute(f"SELECT {names} FROM ({a}) EXCEPT ALL SELECT {names} FROM ({b}) LIMIT 3").fetchall() == []


def test_line_profile_has_one_shuffle(spark):
    plan = registry.QUERIES["line_profile"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
