"""Every registered query that has an oracle gives the oracle's rows."""

import duckdb
import pytest

from quillmark.oracles import ORACLES
from quillmark.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def table(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    show = lambda v: str(round(v, 6) + 0.0 if isinstance(v, float) else v)
    return sorted(names), sorted(tuple(show(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    assert rows
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert table(rows, got.columns) == table(want.fetchall(), want.columns)
