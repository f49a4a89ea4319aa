import math

import duckdb
import pytest

from geoloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_like_duckdb(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=str)
    if name in plans.oracle_sql():
        r = duck.execute(plans.oracle_sql()[name])
        names = [c[0] for c in r.description]
        assert sorted(names) == cols
        want = sorted((tuple(norm(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=str)
        assert got == want
