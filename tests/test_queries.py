"""Every registered query with an SQL twin gives the twin's rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in sorted(os.listdir(SF)):
        path = f"{SF}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def shown(row):
    return tuple("null" if x is None or x != x else f"{x:.6f}" if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_its_twin(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(shown(r) for r in df.select(*cols).collect())
    cur = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(shown(r[names.index(c)] for c in cols) for r in cur.fetchall())
    assert got == want


def test_the_rest_runs_alone():
    """Without the optional part the entry still offers the other queries."""
    import subprocess
    import sys

    code = "import sys; sys.modules['docspan.llm'] = None; import __spark_entry__ as e; assert 'line_boxes' in e.queries() and not any(q.startswith('op') and q[2].isdigit() for q in e.queries()) and 'pipeline' not in e.queries()"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
