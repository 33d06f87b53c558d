import glob
import os

import duckdb
import pytest

from tests.test_entry import BASE, plain
from tracewright.llm import queries


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{BASE}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_end_to_end(spark, duck, name):
    """Every query runs over whole tables; where SQL can say it, with SQL's rows."""
    df = queries.QUERIES[name](spark, BASE)
    rows = df.collect()
    assert rows
    if name in queries.ORACLE:
        got = sorted(str([plain(r[c]) for c in sorted(df.columns)]) for r in rows)
        found = duck.execute(queries.ORACLE[name])
        columns = [d[0] for d in found.description]
        want = sorted(str([plain(v) for _, v in sorted(zip(columns, r, strict=True))]) for r in found.fetchall())
        assert sorted(columns) == sorted(df.columns) and got == want
