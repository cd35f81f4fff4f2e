"""Literal calendar cases, and the join algebra against bisection."""

from bisect import bisect_left, bisect_right
from datetime import date, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketframe.operators.calendar import Calendar, calendar_of, daily_update, extended, full_init, merged, strict

D = date.fromisoformat
THREE = ["2024-01-02", "2024-01-03", "2024-01-04"]


@pytest.fixture(scope="module")
def cal(spark):
    return calendar_of(spark, THREE)


def ask(spark, f, *days):
    df = spark.createDataFrame([(k, D(d) if d else None) for k, d in enumerate(days)], "k long, d date")
    out = f(df)
    name = next(c for c in out.columns if c not in ("k", "d"))
    return [str(r[name]) if r[name] is not None else None for r in out.orderBy("k").collect()]


def test_is_session(spark, cal):
    assert ask(spark, lambda df: cal.is_session(df, "d"), "2024-01-02", "2024-01-01", "2024-01-05", None) == ["True", "False", "False", None]


def test_next_and_prev(spark, cal):
    assert ask(spark, lambda df: cal.next(df, "d"), "2024-01-02", "2024-01-05", "2020-05-05") == ["2024-01-03", None, "2024-01-02"]
    assert ask(spark, lambda df: cal.next(df, "d", 2), "2024-01-02") == ["2024-01-04"]
    assert ask(spark, lambda df: cal.prev(df, "d"), "2024-01-04", "2024-01-02", "2030-01-01") == ["2024-01-03", None, "2024-01-04"]
    assert ask(spark, lambda df: cal.prev(df, "d", 2), "2024-01-04") == ["2024-01-02"]
    for move in (cal.next, cal.prev):
        with pytest.raises(ValueError, match="shift"):
            move(spark.createDataFrame([(D("2024-01-02"),)], "d date"), "d", 0)


def test_strict_raises_out_of_range(spark, cal):
    df = strict(cal.next(spark.createDataFrame([(D("2024-01-05"),)], "d date"), "d"), "next_date", "d")
    with pytest.raises(Exception, match="no session for 2024-01-05"):
        df.collect()


def test_between_and_membership(spark, cal):
    days = lambda a, b: [str(r[0]) for r in cal.between(a, b).collect()]
    assert days("2024-01-02", "2024-01-04") == THREE
    assert days("2024-01-04", "2024-01-02") == days("2024-01-10", "2024-01-15") == []
    df = spark.createDataFrame([(0, D("2024-01-01")), (1, D("2024-01-02")), (2, D("2024-01-05")), (3, D("2024-01-03"))], "k long, d date")
    assert [str(r.d) for r in cal.only_sessions(df, "d").orderBy("k").collect()] == ["2024-01-02", "2024-01-03"]


def test_align(spark, cal):
    assert ask(spark, lambda df: cal.align(df, "d", "next"), "2024-01-03", "2024-01-01") == ["2024-01-03", "2024-01-02"]
    assert ask(spark, lambda df: cal.align(df, "d", "prev"), "2024-01-05") == ["2024-01-04"]
    wider = calendar_of(spark, [*THREE, "2024-01-08"])
    assert ask(spark, lambda df: wider.align(df, "d", "nearest"), "2024-01-05", "2024-01-06", "2024-01-09", "2024-01-01") == ["2024-01-04", "2024-01-08", None, None]
    with pytest.raises(ValueError, match="how"):
        cal.align(spark.createDataFrame([(D("2024-01-02"),)], "d date"), "d", "up")


def test_add(spark, cal):
    for n, day, want in ((1, "2024-01-02", "2024-01-03"), (2, "2024-01-02", "2024-01-04"), (-1, "2024-01-04", "2024-01-03"), (-2, "2024-01-04", "2024-01-02"), (0, "2024-01-03", "2024-01-03"), (0, "2024-01-06", "2024-01-06")):
        assert ask(spark, lambda df, n=n: cal.add(df, "d", n), day) == [want]


def test_month_end_and_latest(spark, cal):
    df = spark.createDataFrame([(2024, 1)], "y int, m int")
    assert str(cal.month_end(df, F.col("y"), F.col("m")).first().month_end) == "2024-01-04"
    wider = calendar_of(spark, ["2023-12-29", *THREE])
    at = spark.createDataFrame([(0, datetime(2024, 1, 2, 17)), (1, datetime(2024, 1, 2, 14)), (2, datetime(2024, 1, 6, 9))], "k long, now timestamp_ntz")
    assert [str(r.latest) for r in wider.latest(at, "now").orderBy("k").collect()] == ["2024-01-02", "2023-12-29", "2024-01-04"]


def test_empty_calendar_answers_null(spark):
    empty = Calendar(spark.createDataFrame([], "trade_date date"))
    assert ask(spark, lambda df: empty.next(df, "d"), "2024-01-02") == [None]
    assert ask(spark, lambda df: empty.align(df, "d", "nearest"), "2024-01-02") == [None]
    assert ask(spark, lambda df: empty.is_session(df, "d"), "2024-01-02") == ["False"]


def sessions(spark, *days):
    return spark.createDataFrame([(D(d),) for d in days], "trade_date date")


def test_updates(spark):
    three = sessions(spark, *THREE)
    assert extended(three, sessions(spark, "2024-01-04", "2026-01-05", "2026-01-08", "2026-02-05"), "2026-01-31").count() == 5
    assert merged(three, sessions(spark, "2024-01-04", "2024-01-05")).count() == 4
    rows, added = full_init(None, sessions(spark, "2024-01-05", "2024-01-05", "2024-03-01"), D("2024-01-01"), D("2024-01-10"))
    assert (rows.count(), added) == (1, 0)
    assert full_init(three, sessions(spark, "2024-01-05", "2024-01-08"), D("2024-01-01"), D("2024-01-10"))[1] == 2
    rows, added = daily_update(three, sessions(spark, "2024-01-05", "2024-01-08", "2024-01-12"), D("2024-01-10"), 30)
    assert added == 3 and str(rows.agg(F.max("trade_date")).first()[0]) == "2024-01-12"
    assert daily_update(three, sessions(spark, "2024-01-05"), D("2024-01-04"))[1] == 0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.integers(0, 40), min_size=1, max_size=12), st.integers(1, 3))
def test_algebra_is_bisection(spark, offsets, k):
    first = date(2024, 2, 1)
    days = sorted(first + timedelta(o) for o in offsets)
    asked = [first + timedelta(o) for o in range(-4, 46)]
    cal = Calendar(spark.createDataFrame([(d,) for d in days], "trade_date date"))
    df = cal.prev(cal.next(spark.createDataFrame([(d,) for d in asked], "d date"), "d", k), "d", k)
    for r in df.collect():
        up, down = bisect_right(days, r.d) + k - 1, bisect_left(days, r.d) - k
        assert r.next_date == (days[up] if up < len(days) else None)
        assert r.prev_date == (days[down] if down >= 0 else None)
