"""Every query of the library (without the subpackage llm) against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from tidemark import registry

registry.load()
FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(rows):
    def of(v):
        return None if v is None else repr(round(v, 7) + 0.0) if isinstance(v, float) and math.isfinite(v) else str(v)

    return sorted((tuple(map(of, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    frame = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = [tuple(r[c] for c in columns) for r in frame.collect()]
    assert got
    if name in registry.SQL:
        found = duck.execute(registry.SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert plain(got) == plain([tuple(r[names.index(c)] for c in columns) for r in found.fetchall()])
