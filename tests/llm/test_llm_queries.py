import duckdb
import pytest

from skald.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "pages", "labels")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(rel.fetchall(), key=str)


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op")) == list(range(1, 14))
