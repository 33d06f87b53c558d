import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

BASE = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CORE = {n for m in entry.MODULES if ".llm." not in m.__name__ for n in m.QUERIES}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{BASE}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return [plain(x) for x in v] if isinstance(v, list) else v


@pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(CORE & set(entry.oracle_sql())))
def test_query_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, BASE)
    got = sorted(str([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    found = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    want = sorted(str([plain(v) for _, v in sorted(zip(columns, r, strict=True))]) for r in found.fetchall())
    assert sorted(columns) == sorted(df.columns) and got == want
