"""Row rules, coverage and the quality report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketframe.functions.scalars import is_iso_day, is_stock_code
from marketframe.operators.calendar import Calendar
from marketframe.specs import DatasetSpec

#: Field rules by kind of column: a date must be there where it is part of the key, and must be one where it is text.
SEVERITY = {"ok": 0, "warn": 1, "fail": 2}


class RowError(ValueError):
    """Rows that break a dataset's rules."""


def rules(df: DataFrame, spec: DatasetSpec) -> dict[str, Column]:
    """Name and condition (true is bad) of each rule: declared columns present, codes well-formed, dates real."""
    found: dict[str, Column] = {}
    for f in spec.schema:
        if f.name not in df.columns:
            found[f"{f.name}:absent"] = F.lit(True)
        elif f.name == spec.code_col:
            found[f"{f.name}:code"] = ~is_stock_code(F.col(f.name).cast("string"), spec.code_form)
        elif isinstance(f.dataType, T.DateType):
            text = isinstance(df.schema[f.name].dataType, T.StringType)
            bad = ~is_iso_day(F.col(f.name)) if text else F.col(f.name).isNull()
            found[f"{f.name}:date"] = bad if f.name in spec.key else bad & F.col(f.name).isNotNull()
    return found


def violations(df: DataFrame, spec: DatasetSpec, extra: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with ``violations``: the names of the rules that each row breaks; unknown columns pass."""
    checks = rules(df, spec) | (extra or {})
    return df.withColumn("violations", F.array_compact(F.array(*(F.when(bad, name) for name, bad in checks.items()))) if checks else F.array().cast("array<string>"))


def split_valid(df: DataFrame, spec: DatasetSpec) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their violations)."""
    checked = violations(df, spec)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def first_violations(df: DataFrame, spec: DatasetSpec, shown: int = 5) -> DataFrame:
    """The key and the violations of the ``shown`` first bad rows by key."""
    key = [k for k in spec.key if k in df.columns]
    return split_valid(df, spec)[1].select(*key, "violations").orderBy(*key, "violations").limit(shown)


def validated(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """``df``, or RowError with the first five bad rows by key."""
    key = [k for k in spec.key if k in df.columns]
    bad = first_violations(df, spec, 6).collect()
    if bad:
        lines = [f"{tuple(r[k] for k in key)}: {', '.join(r['violations'])}" for r in bad[:5]]
        raise RowError("; ".join([*lines, "and more"] if len(bad) > 5 else lines))
    return df


def coverage(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """One row: first_date, last_date, row_count, code_count; zeros and nulls for an empty table."""
    day = F.col(spec.time_col) if spec.time_col else F.lit(None).cast("date")
    code = F.count_distinct(F.col(spec.code_col)) if spec.code_col else F.lit(0).cast("long")
    return df.agg(F.lit(spec.name).alias("type_name"), F.min(day).alias("first_date"), F.max(day).alias("last_date"), F.count("*").alias("row_count"), code.alias("code_count"))


def null_ratios(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, null_ratio (rounded to 6) of each column, from one pass; null for an empty table."""
    one = df.agg(*(F.round(F.avg(F.col(c).isNull().cast("int")), 6).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_ratio")) for c in columns))).alias("x")).select("x.*")


def worst(ratios: DataFrame, n: int = 5) -> DataFrame:
    return ratios.orderBy(F.desc("null_ratio"), "column_name").limit(n)


def stock_gaps(universe: DataFrame, bars: DataFrame) -> DataFrame:
    """Universe codes without any bar."""
    return universe.select("stock_code").distinct().join(bars.select("stock_code").distinct(), "stock_code", "left_anti")


def date_gaps(calendar: Calendar, bars: DataFrame) -> DataFrame:
    """Sessions between the first and the last bar without any bar."""
    ends = bars.agg(F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi")).first()
    due = calendar.sessions.where(F.col("session_date").between(F.lit(ends.lo), F.lit(ends.hi))).select(F.col("session_date").alias("trade_date"))
    return due.join(bars.select("trade_date").distinct(), "trade_date", "left_anti")


def report(universe: DataFrame, calendar: Calendar, bars: DataFrame, columns: Sequence[str], threshold: float = 0.01, shown: int = 5) -> DataFrame:
    """dimension, n_missing, worst_ratio, status, samples, reason of the three dimensions, and of all: the worst of them.

    samples: the ``shown`` smallest missing codes or dates, or the columns with the largest ratios (``column: ratio``); a report's top
    rows, however many are missing.  reason: why a dimension is not ok, else null.  How a dimension is graded is our own rule: no bars
    at all 'fail'; something missing, or a ratio above the threshold, 'warn'.
    """
    empty = F.lit(bars.limit(1).count() == 0)
    first = lambda gaps, c: gaps.select(F.col(c).cast("string").alias("s")).orderBy("s").limit(shown).agg(F.array_sort(F.collect_list("s")).alias("samples"))

    def counted(name: str, gaps: DataFrame, column: str) -> DataFrame:
        n = gaps.agg(F.lit(name).alias("dimension"), F.count("*").alias("n_missing"), F.lit(None).cast("double").alias("worst_ratio"))
        return n.join(first(gaps, column).withColumn("_of", F.lit(name)), F.col("dimension") == F.col("_of")).drop("_of")

    ratios = null_ratios(bars, columns)
    bad = F.col("null_ratio") > threshold
    text = lambda x: F.concat(x["column_name"], F.lit(": "), F.format_number(x["null_ratio"], 4))
    worst_first = F.slice(F.sort_array(F.collect_list(F.when(bad, F.struct((-F.col("null_ratio")).alias("minus"), "column_name", "null_ratio")))), 1, shown)
    top = ratios.agg(F.lit("null_ratio").alias("dimension"), F.count_if(bad).alias("n_missing"), F.max("null_ratio").alias("worst_ratio"), F.transform(worst_first, text).alias("samples"))
    parts = reduce(DataFrame.unionByName, [counted("stock_coverage", stock_gaps(universe, bars), "stock_code"), counted("date_coverage", date_gaps(calendar, bars), "trade_date"), top])
    graded = parts.withColumn("severity", F.when(empty, 2).when(F.col("n_missing") > 0, 1).otherwise(0))
    what = F.when(F.col("dimension") == "stock_coverage", "codes without a bar").when(F.col("dimension") == "date_coverage", "sessions without a bar").otherwise(f"columns above {threshold:g}")
    graded = graded.withColumn("reason", F.when(empty, "no bars").when(F.col("n_missing") > 0, F.concat(F.col("n_missing").cast("string"), F.lit(" "), what)))
    total = graded.agg(F.lit("overall").alias("dimension"), F.sum("n_missing").alias("n_missing"), F.max("worst_ratio").alias("worst_ratio"), F.array().cast("array<string>").alias("samples"), F.max("severity").alias("severity"), F.lit(None).cast("string").alias("reason"))
    status = F.element_at(F.array(F.lit("ok"), F.lit("warn"), F.lit("fail")), F.col("severity") + 1)
    return graded.unionByName(total).select("dimension", "n_missing", "worst_ratio", status.alias("status"), "samples", "reason")


def exit_code(status: str) -> int:
    """0, 1 or 2 for ok, warn or fail."""
    return SEVERITY[status]


def must_rebuild(rows: int | Column, universe_size: int) -> bool | Column:
    """An implausibly small table: some rows, but fewer than 10 and than a quarter of the universe.  Of a number, or of a column."""
    return (rows > 0) & (rows < min(10, universe_size / 4))
