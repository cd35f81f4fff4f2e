"""Queries over derived tables whose keys have more than six digits: all rows count, as their SQL says."""

import duckdb
import pytest
from test_queries import plain

from marketframe.operators import dataquality as Q
from marketframe.plans.domain import numbered_spec
from marketframe.plans.queries import ORACLES, QUERIES
from marketframe.specs import spec_of

KEY = "CASE WHEN {0} < 10 THEN {0} ELSE 999_980 + {0} END"
TABLES = {
    "part": f"SELECT {KEY.format('k')} p_partkey, 'part ' || k p_name, CAST(k % 50 AS INT) p_size FROM range(30) t(k)",
    "orders": "SELECT k o_orderkey, CASE WHEN k % 4 = 0 THEN k % 100 ELSE 999_950 + k * 7 % 100 END o_custkey, CASE WHEN k % 3 = 0 THEN 'F' ELSE 'O' END o_orderstatus, CAST(100_000 + k * 1000 AS DOUBLE) o_totalprice, TIMESTAMP '1996-01-01' + INTERVAL (k * 5) DAY o_orderdate FROM range(400) t(k)",
    "lineitem": f"SELECT k // 3 l_orderkey, CAST(k % 3 AS INT) l_linenumber, {KEY.format('(k * 7 % 30)')} l_partkey, 999_995 + k % 11 l_suppkey, CAST(1 + k % 50 AS DOUBLE) l_quantity, 900.25 + k l_extendedprice, 0.05e0 l_discount, TIMESTAMP '1995-01-02' + INTERVAL (k * 2) DAY l_shipdate FROM range(1200) t(k)",
}


@pytest.fixture(scope="module")
def long(tmp_path_factory):
    folder, con = tmp_path_factory.mktemp("long"), duckdb.connect()
    for name, select in TABLES.items():
        con.execute(f"COPY ({select}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["table_expired", "load_universe_file", "table_read_from", "bad_rows_first", "norm_kline_b", "universe_assign", "universe_build", "stream_batches_once", "table_append", "table_read_many_codes", "table_statistics", "table_truncate", "table_two_writers", "table_upsert", "table_write", "load_dividends", "refresh_dividends"])
def test_keys_above_999_999(spark, long, name):
    folder, con = long
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want and want


def test_the_plain_dataset_still_asks_for_nine_characters(spark):
    codes = ["600000.SH", "1000000.SZ", "0100000.SZ", "SZ1000000", "10000000.SH"]
    rows = spark.createDataFrame([(c, "2024-01-02") for c in codes], "stock_code string, ex_date string")
    bad = lambda spec: [c for c in codes if c in {r.stock_code for r in Q.violations(rows, spec).where("array_contains(violations, 'stock_code:code')").collect()}]
    assert bad(spec_of("Dividend_History")) == codes[1:]
    assert bad(numbered_spec("Dividend_History")) == ["0100000.SZ", "SZ1000000"]
