"""Some of the registered queries against their SQL on the smallest tables; the driver compares all of them."""

import math

import duckdb
import pytest

from tallyfold.plans.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["names", "drift_report", "source_rules", "dedupe_headers", "refused", "scan_delimited", "scan_xlsx", "recon_smart_keys", "fd_nation", "similarity"])
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = QUERIES[name](spark, D)
    rel = con.sql(ORACLE_SQL[name])
    columns = list(rel.columns)
    assert sorted(columns) == sorted(df.columns)
    shown = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else v
    got = sorted(str([shown(r[c]) for c in columns]) for r in df.collect())
    assert got == sorted(str([shown(v) for v in r]) for r in rel.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("n", [12_000, 1_250_000])  # more rows of a key than lists once held, and more pairs of rows than 2^40
def test_smart_keys_of_many_rows(spark, tmp_path, n):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i * 150 AS o_orderkey, i AS o_custkey, i % 1000 / 4 AS o_totalprice, CASE WHEN i % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS o_orderpriority FROM range({n}) t(i)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    rel = con.sql(ORACLE_SQL["recon_smart_keys"])
    want = sorted(map(str, rel.fetchall()))
    got = QUERIES["recon_smart_keys"](spark, str(tmp_path)).select(*rel.columns).collect()
    assert [r.lineage_json.count(",") > 2 * n * 0.9 for r in got] == [True, True]
    assert sorted(str(tuple(r)) for r in got) == want
