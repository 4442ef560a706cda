"""Every registered query of the library against DuckDB, or that it gives rows."""

import pytest
from oracle import compare

from quillspark import catalog

SF = "/root/testdata/sf0.01"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        differences, rows = compare(QUERIES[name], SQL[name], spark, SF)
        assert not differences
        assert rows
    else:
        assert QUERIES[name](spark, SF).count()


def test_entry(spark):
    assert catalog.flagship(spark, "/root/testdata/sf0.001").count() == 20


def test_import_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) > 80; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)
