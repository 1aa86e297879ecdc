"""Every catalogued query against its SQL on the smallest driver tables."""

import os

import duckdb
import pytest

from cuemill.plans import catalog

SF = "/root/testdata/sf0.001"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(str(r[i]) for i in order) for r in rows])


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    assert rows
    if name in catalog.ORACLES:
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
        want = con.sql(catalog.ORACLES[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got.columns, rows) == _rows(want.columns, want.fetchall())
