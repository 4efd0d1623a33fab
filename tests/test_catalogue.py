"""Registered queries against their SQL, on the smallest tables and on those ten times larger, whose part numbers have four digits."""

import os

import duckdb
import pytest

from folioscale.plans import catalogue

DATA = "/root/testdata"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, name, sf):
    db = duckdb.connect()
    for f in os.listdir(f"{DATA}/{sf}"):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS FROM read_parquet('{DATA}/{sf}/{f}')")
    found = catalogue.QUERIES[name](spark, f"{DATA}/{sf}")
    names = sorted(found.columns)
    db.execute(f"CREATE TABLE expected AS {catalogue.SQL[name]}")
    cols = ", ".join(f'"{c}"' for c in names)
    assert sorted(r[0] for r in db.execute("DESCRIBE expected").fetchall()) == names
    expected = sorted(map(repr, db.execute(f"SELECT {cols} FROM expected").fetchall()))
    assert sorted(repr(tuple(r)) for r in found.select(names).collect()) == expected
