"""Every query of the catalog on the smallest tables, against its SQL where it has one."""

import pytest

from pageguard.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    rel = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    want = sorted(rel.select(",".join(f'"{c}"' for c in cols)).fetchall(), key=repr)
    assert rows == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
