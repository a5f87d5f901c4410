"""One local session for all tests, and a comparison with DuckDB."""

from __future__ import annotations

import glob
import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pagewright.session import local_session

    session = local_session(4, 4, "3g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SMALL):
        pytest.skip("the small tables are not here")
    return SMALL


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(r[i] for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=lambda t: tuple((v is None, str(v)) for v in t))


def close(a, b):
    if isinstance(a, float) and b is not None:
        return math.isclose(a, float(b), rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")

    def check(df, sql):
        found = con.execute(sql)
        want_columns, want = rows_of([d[0] for d in found.description], found.fetchall())
        have_columns, have = rows_of(df.columns, [tuple(r) for r in df.collect()])
        assert have_columns == want_columns
        assert len(have) == len(want)
        wrong = [(x, y) for x, y in zip(have, want) if not all(map(close, x, y))]
        assert not wrong, wrong[:3]

    return check
