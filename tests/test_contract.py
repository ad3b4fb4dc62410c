"""Every query of the core against its SQL, and the entry point."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module

from .conftest import tuples

CORE = [m for m in entry_module._modules() if m.__name__.startswith("skein.plans")]
PAIRS = [(name, m) for m in CORE for name in m.ORACLE]


def rows_of(df, columns):
    def plain(x):
        if isinstance(x, float):
            return f"{x:.9g}"
        return str(x)

    return sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect())


def oracle_rows(sf, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf).iterdir():
        if p.suffix == ".parquet":
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}/*.parquet')" if p.is_dir() else f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


@pytest.mark.parametrize("name,module", PAIRS, ids=[n for n, _ in PAIRS])
def test_query_equals_sql(spark, sf, name, module):
    df = module.QUERIES[name](spark, sf)
    names, want = oracle_rows(sf, module.ORACLE[name])
    assert sorted(df.columns) == names
    assert rows_of(df, names) == want


@pytest.mark.parametrize("name", [n for m in CORE for n in m.QUERIES if n not in m.ORACLE])
def test_query_runs(spark, sf, name):
    df = entry_module.queries()[name](spark, sf)
    assert df.columns and df.count() > 0


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    df = entry_module.entry(spark)
    assert df.columns == ["source", "target", "weight"] and len(tuples(df)) >= 0


def test_oracles_belong_to_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
