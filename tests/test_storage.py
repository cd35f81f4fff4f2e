"""Commits of stored tables: several writers, changes beside whole years, what is read and written, expiry, streams delivered twice."""

import random
import time
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from marketframe.functions.scalars import fingerprint
from marketframe.operators import relational as R
from marketframe.sources import snapshots
from marketframe.sources.commits import Commits
from marketframe.sources.snapshots import CommitConflict, Manifest, Table

KEY = ["trade_date", "stock_code"]
BARS = "trade_date date, stock_code string, open double, high double, low double, close double, amount double, volume double"


def code(k):
    return f"{k:06d}.SZ"


def bars(spark, rows):
    """rows: (day as text, code number, close)"""
    return spark.createDataFrame([(date.fromisoformat(d), code(k), x, x, x, x, x, 1.0) for d, k, x in rows], BARS)


def many(spark, years, codes=20, days=30, x=1.0):
    at = spark.range(len(years) * days).select(F.expr(f"date_add(make_date(element_at(array({','.join(map(str, years))}), cast(id div {days} as int) + 1), 1, 1), cast(id % {days} as int))").alias("trade_date"))
    rows = at.select("trade_date", F.explode(F.sequence(F.lit(0), F.lit(codes - 1))).alias("k"))
    value = F.lit(x) + F.col("k")
    return rows.select("trade_date", F.concat(F.lpad(F.col("k").cast("string"), 6, "0"), F.lit(".SZ")).alias("stock_code"), *(value.alias(c) for c in ("open", "high", "low", "close", "amount")), F.lit(1.0).alias("volume"))


def closes(table, **options):
    return {(str(r.trade_date), r.stock_code): r.close for r in table.read(**options).collect()}


def check(table):
    """What the commit says of the table is what a scan finds."""
    df, c = table.read(), table.coverage()
    plain = df.agg(F.min("trade_date"), F.max("trade_date"), F.count("*"), F.count_distinct("stock_code")).first()
    assert (c.first_date, c.last_date, c.row_count, c.code_count) == tuple(plain)
    assert c.fingerprint == fingerprint(df).first()[0]


@pytest.fixture
def table(spark, tmp_path):
    t = Table(spark, str(tmp_path), "Stock_KData")
    t.write(many(spark, [2022, 2023, 2024]))
    return t


def test_random_upserts_are_those_of_a_dictionary(spark, table):
    rng = random.Random(4)
    want = closes(table)
    for step in range(12):
        rows = {(f"{rng.choice([2021, 2022, 2023, 2024])}-01-{rng.randint(1, 31):02d}", rng.randrange(25)): float(step) for _ in range(rng.choice([1, 3, 40, 400]))}
        mode = rng.choice(["replace", "replace", "ignore"])
        n = table.upsert(bars(spark, [(d, k, x) for (d, k), x in rows.items()]), mode)
        new = {(d, code(k)): x for (d, k), x in rows.items()}
        assert n == (len(new) if mode == "replace" else len(new.keys() - want.keys()))
        want = want | new if mode == "replace" else new | want
        assert closes(table) == want
        check(table)
    assert any(p.order for p in table.state()[1].parts)


def test_a_small_upsert_writes_its_rows_and_reads_its_year(spark, table, monkeypatch):
    before, loaded = table.state()[1], []
    plain = Table._load
    monkeypatch.setattr(Table, "_load", lambda self, folder, years, files=None: (loaded.extend(years), plain(self, folder, years, files))[1])
    assert table.upsert(bars(spark, [("2024-01-05", 3, 9.0), ("2024-01-06", 4, 9.0)])) == 2
    Manifest(spark, table.root).update(table)
    assert set(loaded) == {2024}  # neither the merge nor the manifest reads the other years
    loaded.clear()
    table.upsert(bars(spark, [("2024-02-20", 3, 9.0)]))
    Manifest(spark, table.root).update(table)
    assert loaded == []  # a day after all stored ones: no row is read
    after = table.state()[1]
    assert [p for p in after.parts if not p.order] == before.parts
    assert sorted(p.rows for p in after.parts if p.order) == [1, 2]
    check(table)
    plan = table.read()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1
    for k in range(12):
        table.upsert(bars(spark, [("2024-01-05", 3, float(k))]))
    assert len(table.state()[1].of_year(2024)) <= snapshots.CHANGED_FOLDERS + 1 and closes(table)["2024-01-05", code(3)] == 11.0
    check(table)


def between(monkeypatch, table, act):
    """Let ``act`` run once, just before the next claim of ``table``: another writer that is faster."""
    plain, done = table.commits.claim, []

    def claim(number, state):
        if not done:
            done.append(1)
            act()
        return plain(number, state)

    monkeypatch.setattr(table.commits, "claim", claim)


def test_two_writers_of_different_years_both_count(spark, table, monkeypatch):
    other = Table(spark, table.root, "Stock_KData")
    between(monkeypatch, table, lambda: other.upsert(bars(spark, [("2023-01-02", 1, 70.0)])))
    table.upsert(bars(spark, [("2024-01-02", 1, 80.0)]))
    got = closes(table)
    assert (got["2023-01-02", code(1)], got["2024-01-02", code(1)]) == (70.0, 80.0)
    assert [n for n, _ in table.commits.numbers()] == [1, 2, 3]
    check(table)


def test_two_writers_of_one_year_are_one_after_the_other(spark, table, monkeypatch):
    other = Table(spark, table.root, "Stock_KData")
    between(monkeypatch, table, lambda: other.append(bars(spark, [("2024-03-01", 1, 70.0)])))
    table.upsert(bars(spark, [("2024-03-01", 1, 80.0), ("2024-03-02", 1, 80.0)]))
    assert closes(table)["2024-03-01", code(1)] == 80.0
    check(table)
    between(monkeypatch, table, lambda: other.append(bars(spark, [("2024-04-01", 1, 70.0)])))
    with pytest.raises(R.KeyConflictError):  # seen in the second attempt only
        table.append(bars(spark, [("2024-04-01", 1, 1.0)]))
    assert closes(table)["2024-04-01", code(1)] == 70.0
    monkeypatch.setattr(table.commits, "claim", lambda *a: (other.upsert(bars(spark, [("2024-01-01", 1, 0.0)])), False)[1])
    monkeypatch.setattr(snapshots, "ATTEMPTS", 2)
    with pytest.raises(CommitConflict):
        table.upsert(bars(spark, [("2024-01-01", 1, 5.0)]))


def test_a_number_is_claimed_once(spark, tmp_path):
    a, b = (Commits(spark, str(tmp_path / "c")) for _ in range(2))
    assert a.newest() == (0, {}) and a.claim(1, {"by": "a"}) and not b.claim(1, {"by": "b"}) and b.claim(2, {"by": "b"})
    assert a.state(1) == {"by": "a"} and a.newest() == (2, {"by": "b"})
    assert not [p for p in (tmp_path / "c").iterdir() if "tmp" in p.name]


def test_two_writers_of_the_manifest(spark, table, monkeypatch):
    m, other = Manifest(spark, table.root), Manifest(spark, table.root)
    calendar = Table(spark, table.root, "Trade_Date")
    calendar.write(spark.createDataFrame([(date(2024, 1, 2),)], "trade_date date"))
    plain, done = m.commits.claim, []
    monkeypatch.setattr(m.commits, "claim", lambda n, s: (done or (done.append(1), other.update(calendar)), plain(n, s))[1])
    m.update(table)
    assert {r.type_name for r in m.read().collect()} == {"Stock_KData", "Trade_Date"}


def test_codes_open_only_their_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "FILE_ROWS", 4000)
    t = Table(spark, str(tmp_path), "Stock_KData")
    t.write(many(spark, [2023, 2024], codes=5000, days=4))
    t.upsert(bars(spark, [("2024-01-02", 7, 9.0)]))
    asked = [code(k) for k in range(100, 110)]
    every, some = set(t.read().inputFiles()), set(t.read(codes=asked).inputFiles())
    assert len(every) > 9 and len(some) == 2  # ten neighbours: a file for each year
    assert t.read(codes=asked).count() == 80 and t.read(codes=[code(7)], start="2024-01-02", end="2024-01-02").first().close == 9.0
    long = [code(k) for k in range(0, 1200)] + ["none"]
    frame = spark.createDataFrame([(c,) for c in long], "c string")
    df = t.read(codes=long, start="2024-01-01")
    assert df.count() == t.read(codes=frame, start="2024-01-01").count() == 1200 * 4
    assert "LeftSemi" in df._jdf.queryExecution().optimizedPlan().toString() and len(set(df.inputFiles())) < len(every) / 2
    assert t.read(codes=["none"]).count() == 0


def test_expiry_bounds_commits_and_folders(spark, tmp_path):
    t = Table(spark, str(tmp_path), "Stock_KData")
    t.write(many(spark, [2024], codes=5, days=5))
    old = t.read(version=1)
    for k in range(20):
        t.upsert(bars(spark, [("2024-01-02", 1, float(k))]))
        if k % 5 == 4:
            t.expire(timedelta(0), time.time() - 3600)  # nothing is that old
    assert len(t.commits.numbers()) == 21 and old.where("stock_code = '000001.SZ' and trade_date = '2024-01-02'").first().close == 2.0
    gone = t.expire(timedelta(0), time.time() + 60)
    assert gone["commits"] == 20 and len(t.commits.numbers()) == 1
    left = {p.name for p in (tmp_path / "Stock_KData").glob("snapshot-*")}
    assert left == {p.folder for p in t.state()[1].parts} == {p.name for p in (tmp_path / "Stock_KData" / "_codes").glob("snapshot-*")}
    assert closes(t)["2024-01-02", code(1)] == 19.0 and t.expire(timedelta(0), time.time() + 60) == {"commits": 0, "folders": 0}
    check(t)


def test_a_batch_counts_once(spark, table):
    rows = bars(spark, [("2025-01-02", 1, 5.0)])
    assert table.append(rows, batch=("cp", 0)) == 1 and table.append(rows, batch=("cp", 0)) == 0
    assert table.upsert(bars(spark, [("2025-01-02", 1, 6.0), ("2025-01-03", 1, 6.0)]), "ignore", batch=("cp", 1)) == 1
    table.upsert(bars(spark, [("2025-01-02", 1, 8.0)]))
    assert table.upsert(bars(spark, [("2025-01-02", 1, 6.0)]), batch=("cp", 1)) == 0 and closes(table)["2025-01-02", code(1)] == 8.0
    assert table.append(rows.limit(0), batch=("other", 3)) == 0 and table.state()[1].batches == {"cp": 1, "other": 3}
    with pytest.raises(R.KeyConflictError):
        table.append(rows, batch=("cp", 2))


def test_rows_without_a_day_or_code(spark, tmp_path):
    t = Table(spark, str(tmp_path), "Dividend_History")
    row = lambda c, d, x: spark.createDataFrame([(c, d, None, None, None, x, None, None, None)], t.spec.schema)
    t.write(row("600000.SH", date(2024, 1, 2), 1.0))
    t.upsert(row("600000.SH", date(2024, 1, 2), 2.0).union(row("000001.SZ", date(2023, 1, 2), 3.0)))
    assert {(r.stock_code, r.dividend_per_share) for r in t.read().collect()} == {("600000.SH", 2.0), ("000001.SZ", 3.0)}
    assert t.upsert(row("600000.SH", date(2024, 1, 2), 9.0).limit(0)) == 0 and t.upsert(row("600000.SH", date(2024, 1, 2), 9.0), "ignore") == 0
    twice = row("600000.SH", date(2024, 1, 2), 4.0)
    with pytest.raises(R.KeyConflictError):
        t.upsert(twice.union(twice))
    assert t.upsert(twice.union(twice), dedup="keep") == 2 and t.read().count() == 3 and t.upsert(twice.union(twice), dedup="last") == 2 - 1 and t.read().count() == 2
