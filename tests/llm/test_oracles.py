"""Every pipeline query with SQL gives the SQL's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from procsim.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(rows):
    number = lambda x: round(float(x), 6) if not isinstance(x, (bool, str)) and x is not None else x
    return sorted([tuple(number(x) for x in r) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    expected = con.execute(ORACLES[name])
    place = [x[0] for x in expected.description]
    assert sorted(place) == columns
    raw = expected.fetchall()
    assert plain([[r[place.index(c)] for c in columns] for r in raw]) == plain([[r[c] for c in columns] for r in found.collect()])
