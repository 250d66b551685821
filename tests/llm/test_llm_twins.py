"""Every query of the subpackage with a SQL twin against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from cadenza.llm import queries


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twin(spark, sf_dir, db, name):
    df = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    plain = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=str)
    out = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=str)
