"""Trading-calendar arithmetic on whole columns of dates.

Two small frames (a few hundred rows for each year) answer every question by equal keys: ``sessions`` (ord from 1, session_date) and
``days`` (cal_date, cnt_le, cnt_lt: sessions up to, and before, each natural day).  The k-th session after d is number
``cnt_le(d) + k``, the k-th before it ``cnt_lt(d) - k + 1``.  A date beyond the frames' span is brought to its edge first.  Both frames are
made from the sessions' dates, of which there is at most one a natural day, so the driver can hold them; nothing stays cached.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Calendars longer than this are not broadcast: 300 years of days.
BROADCAST_DAYS = 110_000


class Calendar:
    """Sessions of a market.  Null dates are dropped, repeated ones count once; without sessions every answer is null."""

    def __init__(self, sessions: DataFrame, column: str = "trade_date") -> None:
        spark = sessions.sparkSession
        days = sessions.select(F.col(column).cast("date").alias("d")).where("d is not null").distinct()
        held = sorted(r.d for r in days.collect())  # at most one row for each natural day
        self.count = len(held)
        self.first, self.last = (held[0], held[-1]) if held else (None, None)
        self.sessions = spark.createDataFrame(list(enumerate(held, 1)), "ord long, session_date date")
        span, upto = [], 0
        if held:
            known, day = set(held), self.first - timedelta(1)
            while day <= self.last + timedelta(1):
                upto += day in known
                span.append((day, upto, upto - (day in known)))
                day += timedelta(1)
        self.days = spark.createDataFrame(span, "cal_date date, cnt_le long, cnt_lt long")

    def _small(self, frame: DataFrame) -> DataFrame:
        return F.broadcast(frame) if not self.count or (self.last - self.first).days < BROADCAST_DAYS else frame

    def placed(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` with cnt_le and cnt_lt of a date column; null for a null date."""
        if not self.count:
            return df.withColumns({"cnt_le": F.lit(None).cast("long"), "cnt_lt": F.lit(None).cast("long")})
        edge = F.least(F.greatest(F.col(column).cast("date"), F.lit(self.first - timedelta(1))), F.lit(self.last + timedelta(1)))
        return df.withColumn("_day", F.when(F.col(column).isNotNull(), edge)).join(self._small(self.days), F.col("_day") == F.col("cal_date"), "left").drop("_day", "cal_date")

    def session(self, df: DataFrame, ord_: Column, name: str) -> DataFrame:
        """``df`` with the session of a number in column ``name``; null if there is none."""
        found = self.sessions.select(F.col("ord").alias("_ord"), F.col("session_date").alias(name))
        return df.withColumn("_at", ord_).join(self._small(found), F.col("_at") == F.col("_ord"), "left").drop("_at", "_ord")

    def _with(self, df: DataFrame, column: str, ord_: Column, name: str) -> DataFrame:
        return self.session(self.placed(df, column), ord_, name).drop("cnt_le", "cnt_lt")

    def is_session(self, df: DataFrame, column: str, name: str = "is_session") -> DataFrame:
        """Whether each date is a session; null for null."""
        known = F.col("cnt_le") > F.col("cnt_lt")
        return self.placed(df, column).withColumn(name, known if self.count else F.when(F.col(column).isNotNull(), F.lit(False))).drop("cnt_le", "cnt_lt")

    def next(self, df: DataFrame, column: str, shift: int = 1, name: str = "next_date") -> DataFrame:
        """The ``shift``-th session strictly after each date; null if there is none.  ValueError if shift < 1."""
        if shift < 1:
            raise ValueError("shift must be 1 or more")
        return self._with(df, column, F.col("cnt_le") + shift, name)

    def prev(self, df: DataFrame, column: str, shift: int = 1, name: str = "prev_date") -> DataFrame:
        """The ``shift``-th session strictly before each date; null if there is none.  ValueError if shift < 1."""
        if shift < 1:
            raise ValueError("shift must be 1 or more")
        return self._with(df, column, F.col("cnt_lt") - (shift - 1), name)

    def between(self, start: date | str, end: date | str) -> DataFrame:
        """Sessions of a closed range, in order; none if start is after end."""
        return self.sessions.where(F.col("session_date").between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date"))).select("session_date").orderBy("session_date")

    def sessions_between(self, df: DataFrame, start: str, end: str, name: str = "n_sessions") -> DataFrame:
        """How many sessions lie in each row's closed range; 0 if it is empty."""
        a = self.placed(df, start).withColumnsRenamed({"cnt_le": "_le", "cnt_lt": "_from"})
        b = self.placed(a, end)
        return b.withColumn(name, F.greatest(F.col("cnt_le") - F.col("_from"), F.lit(0).cast("long"))).drop("_le", "_from", "cnt_le", "cnt_lt")

    def only_sessions(self, df: DataFrame, column: str) -> DataFrame:
        """Rows whose date is a session; columns and, with a position column, their order stay."""
        return df.join(self._small(self.sessions.select(F.col("session_date").alias("_s"))), F.col(column).cast("date") == F.col("_s"), "left_semi")

    def align(self, df: DataFrame, column: str, how: str = "next", name: str = "aligned") -> DataFrame:
        """A session stays; other dates go to the next, previous or nearest session.  Ties: next.  nearest needs both sides."""
        if how not in ("next", "prev", "nearest"):
            raise ValueError(f"how is 'next', 'prev' or 'nearest', not {how!r}")
        both = self.session(self.session(self.placed(df, column), F.col("cnt_le") + 1, "_n"), F.col("cnt_lt"), "_p")
        day = F.col(column).cast("date")
        near = F.when(F.col("_n").isNotNull() & F.col("_p").isNotNull(), F.when(F.datediff("_n", day) <= F.datediff(day, "_p"), F.col("_n")).otherwise(F.col("_p")))
        moved = {"next": F.col("_n"), "prev": F.col("_p"), "nearest": near}[how]
        return both.withColumn(name, F.when(F.col("cnt_le") > F.col("cnt_lt"), day).otherwise(moved)).drop("cnt_le", "cnt_lt", "_n", "_p")

    def add(self, df: DataFrame, column: str, n: Column | int, name: str = "added") -> DataFrame:
        """``n`` sessions on (back if negative); 0 is the date itself, session or not."""
        n = F.lit(n) if isinstance(n, int) else n
        met = self.session(self.placed(df.withColumn("_n", n), column), F.when(F.col("_n") > 0, F.col("cnt_le") + F.col("_n")).when(F.col("_n") < 0, F.col("cnt_lt") + F.col("_n") + 1), "_s")
        return met.withColumn(name, F.when(F.col("_n") == 0, F.col(column).cast("date")).otherwise(F.col("_s"))).drop("cnt_le", "cnt_lt", "_n", "_s")

    def month_end(self, df: DataFrame, year: Column, month: Column, name: str = "month_end") -> DataFrame:
        """The last session up to the end of each month."""
        met = df.withColumn("_end", F.last_day(F.make_date(year, month, F.lit(1))))
        return self.align(met, "_end", "prev", name).drop("_end")

    def latest(self, df: DataFrame, now: str, close_hour: int = 16, name: str = "latest") -> DataFrame:
        """The last closed session at each moment: its own day if that is a session and the hour is ``close_hour`` or later."""
        met = self.placed(df.withColumn("_today", F.col(now).cast("date")), "_today")
        closed = (F.col("cnt_le") > F.col("cnt_lt")) & (F.hour(now) >= close_hour)
        met = self.session(met, F.col("cnt_lt"), "_p")
        return met.withColumn(name, F.when(closed, F.col("_today")).otherwise(F.col("_p"))).drop("cnt_le", "cnt_lt", "_today", "_p")


def strict(df: DataFrame, name: str, asked: str) -> DataFrame:
    """Raises where column ``name`` is null though ``asked`` is not, as the scalar calls do for dates out of range."""
    lost = F.col(asked).isNotNull() & F.col(name).isNull()
    return df.withColumn(name, F.when(lost, F.raise_error(F.concat(F.lit("no session for "), F.col(asked).cast("string"))).cast("date")).otherwise(F.col(name)))


def merged(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """Sessions of both, each once."""
    return stored.select("trade_date").unionByName(fetched.select("trade_date")).where("trade_date is not null").distinct()


def extended(stored: DataFrame, fetched: DataFrame, until: date | str) -> DataFrame:
    """Stored sessions, and fetched ones that lie after the last stored one and up to ``until``."""
    last = stored.agg(F.max("trade_date")).first()[0]
    more = fetched.select("trade_date").where(F.col("trade_date") <= F.lit(str(until)).cast("date"))
    if last is not None:
        more = more.where(F.col("trade_date") > F.lit(last))
    return stored.select("trade_date").unionByName(more.distinct())


def full_init(stored: DataFrame | None, fetched: DataFrame, start: date, today: date, ahead: int = 20) -> tuple[DataFrame, int]:
    """(sessions of stored and of fetched between start and today + ahead, rows added; 0 on the first load)."""
    new = fetched.where(F.col("trade_date").between(F.lit(start), F.lit(today + timedelta(ahead))))
    if stored is None or not stored.limit(1).count():
        return new.select("trade_date").where("trade_date is not null").distinct(), 0
    both = merged(stored, new)
    return both, both.count() - stored.select("trade_date").distinct().count()


def daily_update(stored: DataFrame, fetched: DataFrame, today: date, horizon: int = 20) -> tuple[DataFrame, int]:
    """(sessions, rows added): nothing to do if the last session is today or later, else fetched ones up to today + horizon."""
    last = stored.agg(F.max("trade_date")).first()[0]
    if last is not None and last >= today:
        return stored, 0
    both = extended(stored, fetched, today + timedelta(horizon))
    return both, both.count() - stored.count()


def calendar_of(spark: SparkSession, days: Sequence[str]) -> Calendar:
    """A calendar of literal ISO dates."""
    return Calendar(spark.createDataFrame([(d,) for d in days], "trade_date string"))
