"""Graph queries against their SQL where keys have over six digits, so that several nodes share an id."""

import duckdb
import pytest

from quern import catalog

NAMES = ["graph_neighbors_d1", "graph_neighbors_d2_bidir", "graph_pagerank_step", "graph_path", "clusters_semantic"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Parts 1000000 to 1000019 are the ids p100000 and p100001, which have further nodes, of equal and of other brands."""
    out = str(tmp_path_factory.mktemp("wide"))
    suppliers = [*range(3, 9), *range(1000000, 1000005)]
    parts = [*range(40, 60), 100000, 100001, *range(1000000, 1000020)]
    lines = [(p, s, 0.01 * ((p + s) % 11)) for p in parts for s in suppliers if (p * 7 + s * 3) % 4 == 0 and p >= 100000 or p < 100000 and p % 6 == s - 3]
    tables = {
        "supplier": ([(s, s % 3) for s in suppliers], "s_suppkey long, s_nationkey int"),
        "part": ([(p, f"Brand#{p % 4}") for p in parts], "p_partkey long, p_brand string"),
        "lineitem": (lines, "l_partkey long, l_suppkey long, l_discount double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.mark.parametrize("name", NAMES)
def test_nodes_that_share_an_id(spark, folder, name):
    db = duckdb.connect()
    for t in ("supplier", "part", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = db.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = catalog.queries()[name](spark, folder).select(*columns).collect()
    assert got and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
