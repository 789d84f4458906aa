"""Every registered query of the library runs over the smallest tables, and gives the rows its SQL gives."""

import duckdb
import pytest

from sievewright.plans import registered

D = "/root/testdata/sf0.001"
QUERIES, SQL = registered()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(value):
    """Numbers as rounded floats, so that both engines' types compare; all else by its text."""
    if value is None or isinstance(value, bool):
        return str(value)
    try:
        return f"{float(value):.9g}" if not isinstance(value, str) else value
    except (TypeError, ValueError):
        return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    out = QUERIES[name](spark, D)
    columns = sorted(out.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in out.collect()]
    if name in SQL:
        rel = tables.sql(SQL[name])
        assert sorted(rel.columns) == columns
        order = [rel.columns.index(c) for c in columns]
        assert sorted(rows) == sorted(tuple(plain(r[k]) for k in order) for r in rel.fetchall())
