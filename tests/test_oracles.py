"""Every catalogue query against its SQL, over the smallest tables."""

import duckdb
import pytest

from adslots.oracles import ORACLES
from adslots.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(rows):
    def one(v):
        if v is None or v != v:
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small, duck):
    mine = QUERIES[name](spark, small)
    theirs = duck.execute(ORACLES[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(mine.columns) == sorted(columns)
    assert same(mine.select(*columns).collect()) == same(theirs.fetchall())
