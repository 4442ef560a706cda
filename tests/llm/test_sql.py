"""Operators that have SQL against DuckDB: over a small table of the driver, and over the corpus of corner cases."""

import pytest
from oracle import compare
from test_operators import SCHEMA, corpus

from quillspark.llm import queries as q


@pytest.fixture(scope="module")
def corner_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corner")
    rows = corpus()
    # a repeated row, and one without doc_id
    rows += [rows[3], (None, "a row that has no doc_id", *rows[0][2:])]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
@pytest.mark.parametrize("table", ["driver", "corner"])
def test_sql(spark, corner_dir, name, table):
    differences, rows = compare(q.queries()[name], q.oracle_sql()[name], spark, "/root/testdata/sf0.01" if table == "driver" else corner_dir)
    assert not differences
    assert rows
