"""Every registered query against its SQL twin in DuckDB."""

import os

import duckdb
import pytest

from cliploom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Queries that find nothing in the smallest tables run on these.
LARGER, EMPTY_WHEN_SMALL = os.environ.get("TEST_SF_DIR_LARGE", "/root/testdata/sf0.01"), ("tag_duplicates", "dup_content_key")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return {folder: connected(folder) for folder in (SF, LARGER)}


def canon(row, names):
    out = []
    for n in sorted(names):
        v = row[n]
        out.append(round(v, 3) if isinstance(v, float) else v)
    return tuple(map(str, out))


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    folder = LARGER if name in EMPTY_WHEN_SMALL else SF
    got = catalog.queries()[name](spark, folder)
    want = duck[folder].execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    a = sorted(canon(r.asDict(), names) for r in got.collect())
    b = sorted(canon(dict(zip(names, r)), names) for r in want.fetchall())
    assert len(a) == len(b) and len(a) > 0
    assert a == b
