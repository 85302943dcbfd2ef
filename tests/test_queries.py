"""Every registered query of the reference's operators against its SQL, on the smallest driver tables."""

import os

import duckdb
import pytest

from jobtide.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def value(x):
        if isinstance(x, float):
            return round(x, 9)
        return x.isoformat() if hasattr(x, "isoformat") else x

    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr), [columns[k] for k in order]


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    want = db.execute(sql)
    columns = [c[0] for c in want.description]
    assert plain(rows, df.columns) == plain(want.fetchall(), columns)


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
