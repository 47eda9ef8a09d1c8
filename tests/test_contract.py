import os

import pytest

import __spark_entry__ as entry
from lodestone.plans import catalog

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    cursor = con.execute(catalog.SQL[name])
    columns = [c[0] for c in cursor.description]
    key = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
    got = sorted(map(repr, (key([r[c] for c in columns]) for r in catalog.Q[name](spark, SF).collect())))
    assert got == sorted(map(repr, map(key, cursor.fetchall())))
