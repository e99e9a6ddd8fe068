"""Every registered query with an oracle: Spark result == DuckDB result (sf0.001).

Row count, column names and an order-insensitive hash of the values (floats
rounded to 6 digits), as the driver's correctness gate does at sf0.01.
"""

import pytest

from tools.oracle_check import table_hash  # noqa: E402

from pickwise.plans.registry import all_queries

QUERIES = all_queries()
WITH_SQL = sorted(k for k, q in QUERIES.items() if q.sql)
ROWS_ONLY = sorted(k for k, q in QUERIES.items() if not q.sql)
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", WITH_SQL)
def test_matches_duckdb(spark, duck, key):
    q = QUERIES[key]
    sdf = q.build(spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    rel = duck.execute(q.sql)
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert table_hash(sdf.columns, srows)[0] == table_hash(dcols, drows)[0]


def test_every_query_without_sql_has_a_value_check():
    import os

    text = open(os.path.join(os.path.dirname(__file__), "test_values.py")).read()
    assert [k for k in ROWS_ONLY if f'"{k}"' not in text] == []


def test_entry_contract(spark):
    import __spark_entry__ as E

    out = E.entry(spark)
    rows = out.collect()
    assert len(rows) == 1 and rows[0]["n_problems"] > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_import_without_a_session():
    """The driver may import the entry module before any Spark session exists."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as E; assert len(E.queries()) >= len(E.oracle_sql()) > 0"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=300)
