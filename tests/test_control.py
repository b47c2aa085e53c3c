"""Every query of the control catalog against its SQL."""

import datetime
import math

import duckdb
import pytest

from quern import catalog
from quern.catalog import control
from tests.conftest import SF


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("events", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", control.NAMES)
def test_query_against_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    found = db.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    got = sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in df.collect())
    want = sorted(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in found.fetchall())
    assert got == want
