"""Every query with SQL gives the rows of its SQL."""

import math

import duckdb
import pytest

from echoline.plans.oracles import ORACLES
from echoline.plans.queries import QUERIES

TABLES = "events documents labels embeddings pages benchmark conversations".split()


def plain(v):
    return "NULL" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_alike(spark, sf_dir, name):
    one, two = (sorted(map(str, QUERIES[name](spark, sf_dir).collect())) for _ in range(2))
    assert one and one == two
