import math

import duckdb
import pytest

from tallyloom.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return repr(v)
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, duck, name):
    got = Q.queries()[name](spark, SF)
    rows = got.collect()
    sql = Q.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert canonical(rows, got.columns) == canonical(want.fetchall(), columns)
