"""Scalar functions, upserts, stored tables, manifest, refreshes, panel and quality on small frames."""

import re
from datetime import date

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketframe.functions import scalars as S
from marketframe.operators import dataquality as Q
from marketframe.operators import mapresult as M
from marketframe.operators import normalize as N
from marketframe.operators import relational as R
from marketframe.operators import universe as U
from marketframe.operators.panel import Panel
from marketframe.plans import queries
from marketframe.plans import refresh as P
from marketframe.sources import load
from marketframe.sources.snapshots import Manifest, Table, VersionError, drifted, resume, status
from marketframe.specs import REGISTRY, spec_of
from marketframe.streaming.upsert import stream_upsert

D = date.fromisoformat
BARS = "trade_date date, stock_code string, open double, high double, low double, close double, amount double, volume double"


def bars(spark, *rows):
    return spark.createDataFrame([(D(d), c, x, x, x, x, x, 1.0) for d, c, x in rows], BARS)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_codes(spark):
    full = lambda c: one(spark, S.to_full_stock_code(F.lit(c)))
    assert [full(c) for c in ("600000", "1", " 300750 ", "900001", "1234567", "abc", None)] == ["600000.SH", "000001.SZ", "300750.SZ", None, None, None, None]
    with pytest.raises(Exception, match="not a stock code"):
        one(spark, S.to_full_stock_code(F.lit("9"), strict=True)), one(spark, S.to_full_stock_code(F.lit("999999"), strict=True))
    assert one(spark, S.vendor_code(F.lit("600000.SH"), "sh.600000")) == "sh.600000"
    assert one(spark, S.from_dotted_code(F.lit("sh.600000"))) == "600000.SH" and one(spark, S.from_dotted_code(F.lit("600000"))) == "600000"
    assert [one(spark, S.is_stock_code(F.lit(c))) for c in ("600000.SH", "60000.SH", "600000.BJ", "abcdef.SZ", None)] == [True, False, False, True, False]


@pytest.mark.parametrize(("text", "ok"), [("2024-01-02", True), ("2024-02-29", True), ("2023-02-29", False), ("2024-1-2", False), ("2024/01/02", False), ("20240102", False), ("2024-13-01", False), ("", False), (None, False)])
def test_iso_days(spark, text, ok):
    assert one(spark, S.is_iso_day(F.lit(text))) is ok


def test_days_numbers_versions(spark):
    assert [str(one(spark, S.to_day(F.lit(x)))) for x in ("2024-01-02 10:00:00", "2024-01-02", "2024-01-02Tzz", "x", None)] == ["2024-01-02"] * 3 + ["None"] * 2
    assert [one(spark, S.to_number(F.lit(x))) for x in ("1.5", "-", "NaN", None)] == [1.5, None, None, None]
    assert one(spark, S.compact_day(F.lit(None).cast("date"), "2020-01-01")) == "2020-01-01"
    cmp = lambda a, b: one(spark, S.compare_versions(F.lit(a), F.lit(b)))
    assert [cmp("1.2", "1.10"), cmp("2.0", "1.9"), cmp("1.0", "1.0"), cmp("1", "1.0"), cmp("1.x", "1.0")] == [-1, 1, 0, -1, 0]
    assert [one(spark, S.is_clock(F.lit(x))) for x in ("00:00", "23:59", "24:00", "9:30")] == [True, True, False, False]


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a int, b string")
    f = lambda df: S.fingerprint(df).first()[0]
    assert f(a) == f(a.orderBy(F.desc("a")).repartition(3)) != f(a.distinct())


def test_upsert_modes(spark):
    old, new = bars(spark, ("2024-01-02", "000001.SZ", 1.0), ("2024-01-03", "000001.SZ", 2.0)), bars(spark, ("2024-01-03", "000001.SZ", 9.0), ("2024-01-04", "000001.SZ", 3.0))
    key = ["trade_date", "stock_code"]
    closes = lambda df: sorted(r.close for r in df.collect())
    assert closes(R.upserted(old, new, key)) == [1.0, 3.0, 9.0]
    assert closes(R.upserted(old, new, key, "ignore")) == [1.0, 2.0, 3.0]
    with pytest.raises(R.KeyConflictError, match="2024, 1, 3"):
        R.upserted(old, new, key, "error")
    twice = new.union(new)
    with pytest.raises(R.KeyConflictError, match="more than once"):
        R.upserted(old, twice, key)
    assert R.upserted(old, twice, key, dedup="keep").count() == 5 and R.upserted(old, twice, key, dedup="last").count() == 3
    nulls = spark.createDataFrame([(None, "000001.SZ", *[5.0] * 6)], BARS)
    assert R.upserted(nulls, nulls, key).count() == 1


def test_stored_table(spark, tmp_path):
    t, m = Table(spark, str(tmp_path), "Stock_KData"), Manifest(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.append(bars(spark, ("2023-12-29", "000001.SZ", 1.0), ("2024-01-02", "600000.SH", 2.0))) == 2
    with pytest.raises(R.KeyConflictError):
        t.append(bars(spark, ("2024-01-02", "600000.SH", 2.0)))
    before = {p.name for p in (tmp_path / "Stock_KData").iterdir()}
    t.upsert(bars(spark, ("2024-01-02", "600000.SH", 7.0), ("2024-01-03", "600000.SH", 3.0)))
    written = next(p for p in (tmp_path / "Stock_KData").iterdir() if p.name not in before)
    assert [p.name for p in written.glob("_year=*")] == ["_year=2024"]  # the other year is not written again
    assert [(str(r.trade_date), r.close) for r in t.read(ordered=True).collect()] == [("2023-12-29", 1.0), ("2024-01-02", 7.0), ("2024-01-03", 3.0)]
    assert t.read(start="2024-01-01", end="2024-12-31", codes=["600000.SH"], columns=["close"]).count() == 2
    assert t.upsert(bars(spark, ("2024-01-03", "600000.SH", 1.0), ("2024-01-04", "600000.SH", 1.0)), conflict="ignore") == 1
    m.update(t, "abc")
    row = m.entry("Stock_KData")
    assert (str(row.first_date), str(row.last_date), row.row_count, row.code_count, row.schema_version) == ("2023-12-29", "2024-01-04", 4, 2, "1.0")
    assert m.is_universe_stale("abd", "Stock_KData") and not m.is_universe_stale("abc", "Stock_KData") and not m.is_universe_stale(None, "Stock_KData")
    assert m.resume_range("Stock_KData", D("2024-01-10")) == (D("2024-01-05"), D("2024-01-10")) and m.resume_range("Universe", D("2024-01-10"))[0] == D("2020-01-01")
    assert not drifted(t) and load.read_window(spark, str(tmp_path), None, None).count() == 4
    assert status(spark, str(tmp_path), list(REGISTRY)).agg(F.sum("row_count")).first()[0] == 4
    t.truncate()
    assert t.exists() and t.read().count() == 0 and t.read().columns == t.spec.columns
    assert m.delete("Stock_KData") and not m.delete("Stock_KData") and m.entry("Stock_KData") is None


def test_versions_are_guarded(spark, tmp_path):
    from dataclasses import replace

    t, m = Table(spark, str(tmp_path), replace(spec_of("Stock_KData"), version="2.0")), Manifest(spark, str(tmp_path))
    t.write(bars(spark, ("2024-01-02", "600000.SH", 2.0)))
    m.update(t)
    old = Table(spark, str(tmp_path), "Stock_KData")
    with pytest.raises(VersionError):
        old.read(manifest=m)
    with pytest.raises(VersionError):
        m.update(old)


def test_csv_table(spark, tmp_path):
    t = Table(spark, str(tmp_path), "TradeDate")
    assert t.write(spark.createDataFrame([(D("2024-01-02"),), (D("2024-01-03"),)], "trade_date date")) == 2
    assert [str(r[0]) for r in load.load_trade_calendar(spark, str(tmp_path), "2024-01-01", "2024-01-02").collect()] == ["2024-01-02"]
    t.write(spark.createDataFrame([], "trade_date date"))
    assert t.read().count() == 0


def test_resume():
    assert resume(D("2024-01-05"), D("2024-01-10")) == (D("2024-01-06"), D("2024-01-10"))
    assert resume(D("2024-01-12"), D("2024-01-10")) == (D("2024-01-11"), D("2024-01-10"))
    assert resume(D("2024-01-10"), D("2024-01-10"))[0] == D("2024-01-11")


def test_refresh(spark, tmp_path):
    root = str(tmp_path)
    landed = bars(spark, ("2024-01-02", "600000.SH", 2.0), ("2024-01-02", "000001.SZ", 1.0)).withColumn("source", F.lit("em"))
    both = landed.union(bars(spark, ("2024-01-02", "600000.SH", 5.0)).withColumn("source", F.lit("sina")))
    with pytest.raises(ValueError, match="universe is empty"):
        P.update(spark, root, "Stock_KData", both, D("2024-01-03"))
    members = spark.createDataFrame([("600000.SH", "a"), ("000001.SZ", "b"), ("600000.SH", "a")], "stock_code string, stock_name string")
    assert P.update(spark, root, "Universe", members, D("2024-01-03")) == {"total": 2, "added": 2}
    assert P.update(spark, root, "Universe", members, D("2024-01-03")) == {"total": 2, "added": 0}
    assert P.update(spark, root, "Stock_KData", both, D("2024-01-03")).action == "full"
    assert sorted(r.close for r in load.load_kdata(spark, root, [], None, None).bars.collect()) == [1.0, 5.0]
    assert P.update(spark, root, "Stock_KData", both, D("2024-01-02")).action == "up_to_date"
    assert P.update(spark, root, "Stock_KData", both, D("2024-01-05")).action == "skipped"
    more = bars(spark, ("2024-01-04", "600000.SH", 6.0)).withColumn("source", F.lit("tx"))
    s = P.update(spark, root, "Stock_KData", both.union(more), D("2024-01-05"))
    assert (s.action, s.rows, s.start) == ("updated", 1, D("2024-01-03"))
    assert P.ranked(both, "Stock_KData", "em").count() == 2
    dividends = spark.createDataFrame([("600000.SH", D("2024-01-02"), 0.5)], "stock_code string, ex_date date, dividend_per_share double")
    full = dividends.select(*(F.col(f.name) if f.name in dividends.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in spec_of("Dividend_History").schema))
    assert P.update(spark, root, "Dividend_History", full, D("2024-01-05")).action == "full"
    today = Manifest(spark, root).entry("Dividend_History").updated_at.date()
    assert P.update(spark, root, "Dividend_History", full, today).action == "up_to_date"
    with pytest.raises(ValueError, match="no dataset"):
        P.update(spark, root, "Nothing", full, today)


def test_stream_is_one_batch(spark, tmp_path):
    table, landed = Table(spark, str(tmp_path), "Stock_KData"), str(tmp_path / "landed")
    bars(spark, ("2024-01-02", "600000.SH", 2.0)).withColumn("seq", F.lit(1)).write.parquet(landed)
    schema = T.StructType([*table.spec.schema.fields, T.StructField("seq", T.IntegerType())])
    run = lambda: stream_upsert(spark.readStream.schema(schema).parquet(landed), table, str(tmp_path / "cp"), order=["seq"]).awaitTermination()
    run()
    bars(spark, ("2024-01-02", "600000.SH", 3.0), ("2024-01-03", "600000.SH", 4.0)).withColumn("seq", F.lit(2)).write.mode("append").parquet(landed)
    run()
    run()
    assert [r.close for r in table.read(ordered=True).collect()] == [3.0, 4.0]


def test_panel(spark):
    p = Panel(bars(spark, ("2024-01-02", "b", 1.0), ("2024-01-03", "a", 5.0), ("2024-01-04", "b", 3.0), ("2024-01-03", "b", 2.0)))
    assert p.rows().count() == 6
    got = {(r.stock_code, r.t): r.ret for r in p.returns().collect()}
    assert got == {("a", 0): None, ("a", 1): None, ("a", 2): None, ("b", 0): None, ("b", 1): 1.0, ("b", 2): 0.5}
    assert [r.stock_code for r in Panel(p.bars, ["b", "z"]).stocks.orderBy("n").collect()] == ["b", "z"]
    assert {r.stock_code: r.is_active for r in p.active_mask("2024-01-02").collect()} == {"a": False, "b": True}
    assert not any(r.is_active for r in p.active_mask("2030-01-01").collect())
    assert p.matrix().orderBy("t").first().cells[1][3] == 1.0
    with pytest.raises(ValueError, match="kind"):
        p.returns("squared")
    with pytest.raises(ValueError, match="more than once"):
        Panel(p.bars.union(p.bars), checked=True)
    assert Panel(bars(spark, ("2024-01-02", "b", 1.0)).limit(0)).rows().count() == 0
    sparse = Panel(bars(spark, ("2024-01-02", "b", 1.0), ("2024-01-03", "a", 5.0), ("2024-01-04", "b", 3.0), ("2024-01-04", "a", 6.0)), ["a", "z", "b"])
    assert {(r.stock_code, r.t): r.ret and round(r.ret, 9) for r in sparse.returns().collect()} == {("a", 0): None, ("a", 1): None, ("a", 2): 0.2, ("z", 0): None, ("z", 1): None, ("z", 2): None, ("b", 0): None, ("b", 1): None, ("b", 2): None}
    thin = sparse.returns(dense=False)
    assert thin.count() == 4 and "Generate" not in thin._jdf.queryExecution().optimizedPlan().toString()
    assert sparse.rows().where("stock_code = 'z' and close is null").count() == 3 and Panel(sparse.bars.limit(0), ["z"]).rows().count() == 0
    zero = Panel(bars(spark, ("2024-01-02", "b", 0.0), ("2024-01-03", "b", 1.0)))
    assert [r.ret for r in zero.returns("log").orderBy("t").collect()] == [None, None]


def test_matrix_is_put_together_from_tiles(spark, monkeypatch):
    monkeypatch.setattr("marketframe.operators.panel.TILE", (3, 2))
    p = Panel(bars(spark, *((f"2024-01-{d:02d}", c, float(10 * d + ord(c))) for d in range(1, 9) for c in "abcde" if (d + ord(c)) % 3)))
    tiles = p.tiles().collect()
    assert len(tiles) == 9 and max(len(r.cells) for r in tiles) == 6
    dense = {(r.t, r.n): r.close for r in p.rows().collect()}
    for rows, span in ((p.matrix(), range(8)), (p.matrix(2, 4), range(2, 5))):
        got = {r.t: [c[3] for c in r.cells] for r in rows.collect()}
        assert got == {t: [dense[t, n] for n in range(5)] for t in span}
        assert {r.t: str(r.trade_date) for r in rows.collect()} == {t: f"2024-01-{t + 1:02d}" for t in span}


def test_universe(spark):
    pool = U.loaded(spark.createDataFrame([(0, "600000.SH", "a"), (4, "000001.SZ", "b")], "stock_index long, stock_code string, stock_name string"))
    members = spark.createDataFrame([("300750.SZ", "c", 1), ("600519.SH", "d", 0), ("600000.SH", "a", 2), ("bad", "x", 3)], "stock_code string, stock_name string, at int")
    assert [(r.stock_index, r.stock_code) for r in U.new_members(pool, members, "at").orderBy("stock_index").collect()] == [(5, "600519.SH"), (6, "300750.SZ")]
    assert U.active_count(pool, "1990-01-01").first()[0] == 2 and U.active_count(pool, "1989-12-31").first()[0] == 0
    with pytest.raises(ValueError, match="stock_name"):
        U.loaded(pool.drop("stock_name"))
    assert (U.size(pool), U.size(pool.union(pool), distinct=True)) == (2, 2)
    assert U.code_of(spark.createDataFrame([(4,), (9,)], "stock_index long"), pool).where("stock_code is null").count() == 1


def test_normalise(spark):
    raw = spark.createDataFrame([("2024-01-02 00:00:00", 1, "-", "3"), (None, 600000, "4.5", None)], "`日期` string, `股票代码` int, `开盘` string, `成交量` string")
    a = N.bars_a(raw).orderBy("stock_code").collect()
    assert [(str(r.trade_date), r.stock_code, r.open, r.volume, r.close) for r in a] == [("2024-01-02", "000001.SZ", None, 3.0, None), ("None", "600000.SH", 4.5, None, None)]
    with pytest.raises(ValueError, match="date column"):
        N.bars_a(raw.drop("日期"))
    with pytest.raises(ValueError, match="no bars"):
        N.bars_b(raw.limit(0))
    for kind, width in (("income", 16), ("balance", 21), ("cashflow", 12)):
        s = N.statement(spark.createDataFrame([("2024-03-31", "7")], f"REPORT_DATE string, {N.STATEMENTS[kind][1][0].upper()} string"), kind, "600000.SH")
        assert len(s.columns) == width + 3 and s.first()[2] == 7.0
    with pytest.raises(ValueError, match="kind"):
        N.statement(raw, "other")
    flagged = spark.createDataFrame([("2024-01-02", "1"), ("2024-01-01", "0")], "calendar_date string, is_trading_day string")
    assert [str(r[0]) for r in N.trade_dates_flagged(flagged).collect()] == ["2024-01-02"]
    listed = spark.createDataFrame([("2024-01-02",), ("2024-01-05",)], "session string")
    assert N.trade_dates_listed(listed, "2024-01-03", "2024-01-01").count() == 0 and N.trade_dates_listed(listed, "2024-01-02", "2024-01-03").count() == 1
    with pytest.raises(ValueError, match="unknown index"):
        N.constituents(raw, "dax")
    factor = spark.createDataFrame([("2024-01-02", "600000.SH", "3", "0")], "date string, stock_code string, hfq_close string, close string")
    assert N.adj_factor_a(factor).first().adj_factor is None
    with pytest.raises(ValueError, match="neither"):
        N.adj_factor_a(factor.drop("close"))
    b = N.adj_factor_b(spark.createDataFrame([("2024-01-02", "sh.600000", "1.5")], "tradeDate string, code string, adjustFactor string"))
    assert N.adj_factor_panel([b, b]).count() == 2 and b.first().stock_code == "600000.SH"


def test_quality(spark):
    spec = spec_of("Dividend_History")
    rows = spark.createDataFrame([("600000.SH", "2024-01-02", None), ("bad", "2024-02-30", "x")], "stock_code string, ex_date string, record_date string")
    found = {r.stock_code: set(r.violations) for r in Q.violations(rows, spec).collect()}
    assert {v for v in found["600000.SH"] if not v.endswith("absent")} == set() and {"stock_code:code", "ex_date:date", "record_date:date"} <= found["bad"]
    with pytest.raises(Q.RowError, match="bad"):
        Q.validated(bars(spark, ("2024-01-02", "bad", 1.0)), spec_of("Stock_KData"))
    assert [Q.must_rebuild(n, 100) for n in (0, 9, 10)] == [False, True, False] and Q.must_rebuild(2, 8) is False
    assert [Q.exit_code(s) for s in ("ok", "warn", "fail")] == [0, 1, 2]


def test_map_with_result(spark):
    def inverse(x):
        return 1 / x

    r = M.map_with_result(spark.createDataFrame([(0, 2.0), (1, 0.0)], "k long, x double"), inverse, ["x"], "double", "k")
    assert [(x.k, x.success, x.value) for x in r.orderBy("k").collect()] == [(0, True, 0.5), (1, False, None)]
    assert "ZeroDivisionError" in M.failures(r).first().error and M.successes(r).columns == ["k", "value"]
    assert M.summary(r, "k").first().asDict() == {"n_ok": 1, "n_failed": 1, "n_total": 2, "first_errors": ["ZeroDivisionError: division by zero"]} or M.summary(r, "k").first().n_failed == 1


def test_numbers_without_one_task(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("a"), F.when(F.col("id") % 50 != 0, F.concat(F.lit("x"), F.col("id"))).alias("b"))
    got = R.numbered(df.repartition(7), ["a", "b"], "at", 10)
    assert [r["at"] for r in got.orderBy("a", "b").collect()] == list(range(10, 5010))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [row_number() windowspecdefinition(_range" in plan
    nulls = spark.createDataFrame([(None, "b"), (None, None), (1, None), (0, "z")] * 50, "a int, b string")
    assert [r["at"] for r in R.numbered(nulls, ["a", "b"], "at").orderBy("a", "b").collect()] == list(range(200))
    assert R.numbered(df.limit(0), ["a"], "at").count() == 0 and [r["at"] for r in R.numbered(df.limit(1), ["a"], "at").collect()] == [0]


def test_reports_keep_a_few(spark):
    rows = spark.createDataFrame([("a", k % 3 == 0, k, f"{k:03d}") for k in range(300)] + [("b", True, 1, "x"), (None, False, 1, "n")], "g string, ok boolean, n int, code string")
    got = {r.g: r for r in M.tally(rows, "g", "ok", "n", "code", shown=3).collect()}
    assert (got["a"].n_ok, got["a"].n_failed, got["a"].failed_codes) == (100, 200, ["001", "002", "004"])
    assert got["b"].failed_codes == [] and got[None].failed_codes == ["n"]
    plan = M.tally(rows, "g", "ok", "n", "code")._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_a_tally_of_all_failed_codes(spark, tmp_path):
    """The whole list, as SQL has it: sorted as text, repeats and nulls included, null where nothing failed."""
    orders = [(k, (k * 7919 % 500) if k % 11 else None, "F" if k % 3 else "O", "12"[k % 2]) for k in range(3000)] + [(5000, 1, "O", "9"), (5001, 2, "F", None), (5002, 3, None, "1")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    rows = con.execute(queries.ORACLES["task_tally"]).fetchall()
    got = {r.o_orderpriority: (r.n_ok, r.n_failed, r.total_rows, r.failed_codes) for r in queries.QUERIES["task_tally"](spark, str(tmp_path)).collect()}
    assert got == {r[0]: r[1:] for r in rows}
    assert len(got["1"][3]) == got["1"][1] > 900 and None in got["1"][3] and got["9"][3] is None


def test_a_group_comes_in_frames(spark):
    """A large group is never one frame; what fails or gives nothing is listed, and none of its rows count."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    kind = T.StructType.fromDDL("code string, n long")

    def sizes(frames):
        for f in frames:
            if f["code"].iloc[0] == "late" and len(f) < 1000:
                raise KeyError("late")
            if f["code"].iloc[0] == "none":
                continue
            yield f[["code"]].head(1).assign(n=len(f))

    def total(frames):
        got = [f for f in frames]
        yield got[0][["code"]].head(1).assign(n=sum(int(f["n"].sum()) for f in got))

    try:
        codes = F.when(F.col("id") < 20000, "hot").when(F.col("id") < 22500, "late").when(F.col("id") < 22510, "none").otherwise("few")
        df = spark.range(22600).select(codes.alias("code"), "id")
        rows, problems = M.map_batches(df, "code", sizes, kind)
        got = [(r.code, r.n) for r in rows.collect()]
        assert sum(n for c, n in got if c == "hot") == 20000 and max(n for _, n in got) <= 1000 and {c for c, _ in got} == {"hot", "few"}
        assert {(r.code, r.error) for r in problems.collect()} == {("late", "KeyError: 'late'"), ("none", "no rows")}
        rows, problems = M.map_combine(df, "code", sizes, kind, total, kind, parts=4)
        assert {(r.code, r.n) for r in rows.collect()} == {("hot", 20000), ("few", 90)}
        assert {(r.code, r.error) for r in problems.collect()} == {("late", "KeyError: 'late'"), ("none", "no rows")}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_migrate_legacy(spark, tmp_path):
    for name, head, line in (("raw", "date,open,high,low,close,amount,volume", "2024-01-02,1,2,1,2,9,3"), ("adj", "date,adj_factor", "2024-01-02,1.5")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "600000.csv").write_text(f"{head}\n{line}\n")
    done = load.migrate_legacy(spark, str(tmp_path / "root"), str(tmp_path / "raw/*.csv"), str(tmp_path / "adj/*.csv"))
    assert done == {"Stock_KData_rows": 1, "Stock_KData_stocks": 1, "Stock_Basic_Data_rows": 1, "Stock_Basic_Data_stocks": 1}
    assert load.load_stock_basic_data(spark, str(tmp_path / "root"), None, None).first().adj_factor == 1.5


def test_one_end_of_a_range_prunes_years(spark, tmp_path):
    t = Table(spark, str(tmp_path), "Stock_KData")
    t.write(bars(spark, ("2021-06-01", "000001.SZ", 1.0), ("2022-06-01", "600000.SH", 2.0), ("2023-06-01", "000001.SZ", 3.0), ("2023-06-02", "000001.SZ", 4.0)))
    years = lambda df: set(re.findall(r"\b20\d\d\b", re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", df._jdf.queryExecution().executedPlan().toString())[1]))
    assert years(t.read(start="2022-01-01")) == {"2022", "2023"} and years(t.read(end="2021-12-31")) == {"2021"} and years(t.read()) == {"2021", "2022", "2023"}
    assert t.read(start="2022-01-01").count() == 3 and t.read(start="2030-01-01").count() == 0
    assert len(list((tmp_path / "Stock_KData").glob("snapshot-*/_year=2023/*.parquet"))) == 1
    assert t.files().first().n_files == 3 and t.files().first().n_bytes > 0


def test_adjusted_and_doubled_panels(spark, tmp_path):
    root = str(tmp_path)
    Table(spark, root, "Stock_KData").write(bars(spark, ("2024-01-02", "000001.SZ", 2.0), ("2024-01-03", "000001.SZ", 4.0)))
    factors = spark.createDataFrame([(D("2024-01-02"), "000001.SZ", 1.5)], "trade_date date, stock_code string, adj_factor double")
    Table(spark, root, "Stock_Basic_Data").write(N.basic_data(factors))
    assert [r.adj_close for r in load.load_kdata(spark, root, [], None, None, adjusted=True).rows().orderBy("t").collect()] == [3.0, None]
    assert [r.adj_close for r in load.load_kdata(spark, root, [], None, None).rows().orderBy("t").collect()] == [2.0, 4.0]
    twice = bars(spark, ("2024-01-02", "000001.SZ", 2.0), ("2024-01-02", "000001.SZ", 2.0), ("2024-01-03", "000001.SZ", 2.0))
    for rows in (Panel(twice).rows(), Panel(twice).returns(), Panel(twice).wide("close", ["000001.SZ"])):
        with pytest.raises(Exception, match="more than once"):
            rows.collect()
    none = N.adj_factor_panel([])
    assert none.count() == 0 and none.columns == ["trade_date", "stock_code", "adj_factor"]


def test_shares_are_combined_in_one_pass(spark, monkeypatch):
    """Each function is called once a group for the problems, few rows are one share, and calls keep their tasks; of a code's errors the least
    counts, whole numbers stay whole beside them, and a share's error stands before that of combining."""
    monkeypatch.setattr(M, "SHARE_ROWS", 50)
    partial, kind = T.StructType.fromDDL("code string, n long, big long"), T.StructType.fromDDL("code string, n long, big long")
    seen = spark.sparkContext.accumulator(0)

    def part(frames):
        seen.add(1)
        for f in frames:
            c = f["code"].iloc[0]
            if c == "bad" or c == "some" and (f["id"] == 207).any():
                raise ValueError(c)
            if c != "none":
                yield pd.DataFrame({"code": [c], "n": [len(f)], "big": [2**53 + 1]})

    def combine(frames):
        seen.add(1)
        got = [f for f in frames]
        if got[0]["code"].iloc[0] in ("late", "some"):
            raise KeyError("late")
        yield got[0][["code", "big"]].head(1).assign(n=sum(int(f["n"].sum()) for f in got))

    i = F.col("id")
    code = F.when(i < 100, "hot").when(i < 200, "none").when(i < 300, "some").when(i < 310, "bad").when(i < 320, "late").when(i < 330, "few")
    rows, problems = M.map_combine(spark.range(331).select(code.alias("code"), "id"), "code", part, partial, combine, kind, parts=4)
    assert {(r.code, r.error) for r in problems.collect()} == {("none", "no rows"), ("some", "ValueError: some"), ("bad", "ValueError: bad"), ("late", "KeyError: 'late'")}
    assert seen.value <= 3 * 4 + 4 + 5  # shares of hot, none and some; bad, late, few and null; hot, some, late, few and null
    assert {(r.code, r.n, r.big) for r in rows.collect()} == {("hot", 100, 2**53 + 1), ("few", 10, 2**53 + 1), (None, 1, 2**53 + 1)}
    plan = problems._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsIn") == plan.count("RepartitionByExpression") == 2


def test_legacy_files_come_in_slices(spark, tmp_path, monkeypatch):
    """No read lists more than a slice of the files; a folder or file may be named after the whole code, where six digits don't say the exchange."""
    monkeypatch.setattr(load, "SLICE_FILES", 2)
    asked, plain = [], type(spark.read).csv
    monkeypatch.setattr(type(spark.read), "csv", lambda self, path, *a, **b: (asked.append(path), plain(self, path, *a, **b))[1])
    for k, name in enumerate(("000001", "100000.SZ", "code=000002", "300000", "code=540000.SZ")):
        (tmp_path / "raw" / name).mkdir(parents=True)
        (tmp_path / "adj").mkdir(exist_ok=True)
        (tmp_path / "raw" / name / "part-000009.csv").write_text(f"date,open,high,low,close,amount,volume\n2024-01-02,1,2,1,{k},9,3\n")
        (tmp_path / "adj" / f"{name.removeprefix('code=')}.csv").write_text(f"date,adj_factor\n2024-01-02,{k}.5\n")
    root = str(tmp_path / "root")
    done = load.migrate_legacy(spark, root, str(tmp_path / "raw/*/*.csv"), str(tmp_path / "adj/*.csv"))
    assert set(done.values()) == {5} and all(len(p) <= 2 for p in asked if isinstance(p, list)) and sum(len(p) for p in asked if isinstance(p, list)) >= 10
    codes = ["000001.SZ", "000002.SZ", "100000.SZ", "300000.SZ", "540000.SZ"]
    assert [(r.stock_code, r.close) for r in Table(spark, root, "Stock_KData").read().orderBy("stock_code").collect()] == list(zip(codes, [0.0, 2.0, 1.0, 3.0, 4.0], strict=True))
    assert [(r.stock_code, r.adj_factor) for r in load.load_stock_basic_data(spark, root, None, None).orderBy("stock_code").collect()] == list(zip(codes, [0.5, 2.5, 1.5, 3.5, 4.5], strict=True))
    with pytest.raises(FileNotFoundError):
        load.migrate_legacy(spark, root, str(tmp_path / "none/*.csv"), str(tmp_path / "adj/*.csv"))
