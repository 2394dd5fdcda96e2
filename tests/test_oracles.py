"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from graywether.plans import load_all, registry

load_all()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path += "/*" if os.path.isdir(path) else ""
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "none"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, list) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, con, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cur = con.execute(registry.ORACLES[name])
    theirs = [c[0] for c in cur.description]
    assert sorted(theirs) == columns
    mine = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert mine == sorted(tuple(plain(r[theirs.index(c)]) for c in columns) for r in cur.fetchall())
    assert "decimal" not in str(df.dtypes)
