import math
import os
from collections import Counter

import pytest

from stratalith.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, partitions=4, memory="6g")
    yield s
    s.stop()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v).replace("+00:00", "")
    return v


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in os.listdir(SMALL):
        p = f"{SMALL}/{t}"
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


@pytest.fixture(scope="session")
def same(duck):
    """Compares a DataFrame with SQL: column names, and rows as a bag."""

    def check(df, sql):
        res = duck.execute(sql)
        names = [c[0] for c in res.description]
        assert sorted(names) == sorted(df.columns)
        want = Counter(tuple(plain(v) for v in r) for r in res.fetchall())
        got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
        assert got == want

    return check
