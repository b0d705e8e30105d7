"""Every query with SQL gives DuckDB's rows at the smallest size."""

import math

import duckdb
import pytest

from tidemark.plans import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{D}/{name}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return str(v)[:19] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, D)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert ours == theirs
