"""Every registered corpus query on the smallest tables, against its SQL where there is one."""

from pathlib import Path

import duckdb
import pytest

from fiscalframe.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
EXPECTED = queries.oracle_sql()


@pytest.mark.parametrize("name", [n for n in queries.queries() if n != "pipeline"])
def test_query(spark, name):
    frame = queries.queries()[name](spark, str(DATA))
    rows = frame.collect()
    connection = duckdb.connect()
    for table in ("documents", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    table = "embeddings" if name == "op12_vector_codes" else "documents"
    assert len(rows) == connection.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
    if name in EXPECTED:
        result = connection.execute(EXPECTED[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(frame.columns)
        assert sorted(repr([r[c] for c in sorted(names)]) for r in rows) == sorted(repr([r[names.index(c)] for c in sorted(names)]) for r in result.fetchall())
