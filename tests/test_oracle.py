"""Every bound query against its SQL on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from catastra.plans import bindings, captured, cases, passes, places, readings, stores  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float | decimal.Decimal):
        return repr(round(float(x), 5) + 0.0)
    return str(x)


def compare(df, sql):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = db.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    ours = sorted(tuple(value(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(value(r[names.index(c)]) for c in order) for r in got.fetchall())
    assert ours == theirs


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(bindings.ORACLE))
def test_query(spark, name):
    compare(bindings.QUERIES[name](spark, SF), bindings.ORACLE[name])
