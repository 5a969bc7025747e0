"""Every registered query of the core against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from gleaner.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def _key(rows):
    def text(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "-"
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted(tuple(map(text, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_oracle(spark, name):
    df = registry.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    expected = con.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(df.columns)
    assert _key(df.select(*columns).collect()) == _key(expected.fetchall())


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
