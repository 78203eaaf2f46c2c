import os

import duckdb
import pytest

from designlake.plans import catalogue, copydeck, design, sheets, site, streams

QUERIES = catalogue.queries() | copydeck.queries() | design.queries() | sheets.queries() | site.queries() | streams.queries()
ORACLES = catalogue.SQL | copydeck.SQL | design.SQL | sheets.SQL | site.SQL | streams.SQL

SF = "/root/testdata/sf0.001"


def flat(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert flat(df.select(*cols).collect()) == flat(want.project(quoted).fetchall())
