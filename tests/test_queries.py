"""Every query against its SQL on the smallest tables."""

import math
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")
OWN = [k for k in entry.catalog.queries()]
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 8) + 0.0
    return x


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if name in entry.oracle_sql():
        want = duck.sql(entry.oracle_sql()[name])
        assert sorted(want.columns) == cols
        at = [want.columns.index(c) for c in cols]
        assert [KINDS[dict(df.dtypes)[c]] for c in cols] == [str(want.types[i]) for i in at]
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_entry_without_other_packages():
    """What the corpus part needs and does not find takes its queries away, and no others."""
    code = "import sys; sys.modules['regex'] = None; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(sorted(k for k in e.queries() if k[:2] == 'op' or k == 'pipeline'), len(e.queries()) > 100)"
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=Path(entry.__file__).parent, capture_output=True, text=True, timeout=120)
    assert done.stdout.split("\n")[0] == "[] True", done.stderr


def test_entry(spark):
    assert entry.entry(spark).count() > 0
