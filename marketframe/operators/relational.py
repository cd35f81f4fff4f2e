"""Filters, upserts, set operations and sorting on keyed tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.specs import DatasetSpec


#: Longer lists of codes are a table that is joined, not a list in the plan.
LONG_LIST = 1000
#: Rows that ``numbered`` looks at to find its ranges, and ranges at most.
RANGE_SAMPLE, RANGES = 1024, 64


class KeyConflictError(ValueError):
    """Rows with a key that is already there, or twice in one batch."""


def scan(df: DataFrame, *, start: date | str | None = None, end: date | str | None = None, codes: Sequence[str] | DataFrame | None = None, columns: Sequence[str] | None = None, time_col: str = "trade_date", code_col: str = "stock_code", days: Sequence[date | str] | None = None) -> DataFrame:
    """Closed range of dates, list of codes, list of days, subset of columns; each optional, an empty list of codes is no filter.

    Codes may also be a table with one column; that, and a list of more than ``LONG_LIST``, is a semi-join."""
    if start is not None:
        df = df.where(F.col(time_col) >= F.lit(str(start)).cast("date"))
    if end is not None:
        df = df.where(F.col(time_col) <= F.lit(str(end)).cast("date"))
    if codes is not None and not isinstance(codes, DataFrame) and len(codes) > LONG_LIST:
        codes = df.sparkSession.createDataFrame([(c,) for c in codes], "code string")
    if isinstance(codes, DataFrame):
        df = df.join(codes.select(F.col(codes.columns[0]).alias("_code")).distinct(), F.col(code_col) == F.col("_code"), "left_semi")
    elif codes:
        df = df.where(F.col(code_col).isin(list(codes)))
    if days is not None:
        df = df.where(F.col(time_col).isin([date.fromisoformat(str(d)) for d in days]))
    return df.select(*columns) if columns else df


def in_order(df: DataFrame) -> DataFrame:
    """Sorted by those of (trade_date, stock_code) that it has."""
    by = [c for c in ("trade_date", "stock_code") if c in df.columns]
    return df.orderBy(*by) if by else df


def same_key(a: DataFrame, b: DataFrame, key: Sequence[str]) -> Column:
    """Equal keys, null equal to null."""
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in key))


def keys_of(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.select(*key).distinct()


def without_keys(df: DataFrame, other: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``other``."""
    right = keys_of(other, key)
    return df.join(right, same_key(df, right, key), "left_anti")


def with_keys(df: DataFrame, other: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is in ``other``."""
    right = keys_of(other, key)
    return df.join(right, same_key(df, right, key), "left_semi")


def key_overlap(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct keys that both have."""
    return with_keys(keys_of(new, key), old, key)


def smallest_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: the smallest key, nulls first; no row for an empty table."""
    return df.select(*key).orderBy(*(F.col(k).asc_nulls_first() for k in key)).limit(1)


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def last_by_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the largest ``order``, as one aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(*(F.col(k) if k in key else F.col(f"row.`{k}`") for k in df.columns))


def checked_keys(new: DataFrame, key: Sequence[str], dedup: str) -> DataFrame:
    """Incoming rows with each key once: 'error' raises if one is there twice, 'last' keeps its last row, 'keep' keeps all."""
    if dedup == "keep":
        return new
    if dedup == "last":
        return last_by_key(new.withColumn("_at", F.monotonically_increasing_id()), key, ["_at"]).drop("_at")
    if dedup == "error":
        twice = smallest_key(duplicate_keys(new, key), key).collect()
        if twice:
            raise KeyConflictError(f"key {tuple(twice[0])} occurs more than once in the incoming rows")
        return new
    raise ValueError(f"dedup is 'error', 'last' or 'keep', not {dedup!r}")


def refuse_stored(old: DataFrame, new: DataFrame, key: Sequence[str]) -> None:
    """KeyConflictError with the smallest key that both have."""
    both = smallest_key(key_overlap(old, new, key), key).collect()
    if both:
        raise KeyConflictError(f"key {tuple(both[0])} is already stored")


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str], conflict: str = "replace", dedup: str = "error") -> DataFrame:
    """What a table holds after an upsert.

    conflict 'replace': stored rows whose key is not incoming, and all incoming rows.  'ignore': stored rows, and incoming rows with new
    keys.  'error': raises with the smallest key that both have.  Columns go by name; one that a side lacks is null there.  Null key
    parts equal each other.  dedup: what to do with a key that is twice in the incoming rows.
    """
    new = checked_keys(new, key, dedup)
    if conflict == "replace":
        return without_keys(old, new, key).unionByName(new, allowMissingColumns=True)
    if conflict == "ignore":
        return old.unionByName(without_keys(new, old, key), allowMissingColumns=True)
    if conflict == "error":
        refuse_stored(old, new, key)
        return old.unionByName(new, allowMissingColumns=True)
    raise ValueError(f"conflict is 'replace', 'ignore' or 'error', not {conflict!r}")


def column_drift(df: DataFrame, spec: DatasetSpec) -> tuple[list[str], list[str]]:
    """(columns of the spec that are missing, columns it does not know), each sorted."""
    have, want = set(df.columns), set(spec.columns)
    return sorted(want - have), sorted(have - want)


def adjusted(bars: DataFrame, basic: DataFrame) -> DataFrame:
    """Bars with ``adj_close`` = close * adj_factor of the same day and code; null where there is no factor."""
    factor = basic.select("trade_date", "stock_code", "adj_factor")
    return bars.join(factor, ["trade_date", "stock_code"], "left").withColumn("adj_close", F.col("close") * F.col("adj_factor")).drop("adj_factor")


def first_source(rows: DataFrame, code_col: str = "stock_code", rank_col: str = "source_rank") -> DataFrame:
    """Of several sources, for each code only the rows of the first that has any."""
    best = rows.groupBy(code_col).agg(F.min(rank_col).alias("_best"))
    return rows.join(best, code_col).where(F.col(rank_col) == F.col("_best")).drop("_best")


def numbered(df: DataFrame, order: Sequence[str], name: str, start: int = 0) -> DataFrame:
    """``df`` with its place in ``order`` (nulls first) from ``start`` on, in column ``name``; no task sees all rows.

    A bounded sample gives limits between ranges of ``order``; each row's range follows from its values alone, so it is the same whenever it is
    computed.  The driver adds up one count for each range, and rows are numbered within theirs.  Rows with equal ``order`` are
    numbered in any order.
    """
    found = df.select(*order).orderBy(F.xxhash64(*order)).limit(RANGE_SAMPLE).orderBy(*order).collect()
    limits = [found[len(found) * k // RANGES] for k in range(1, RANGES)] if len(found) >= RANGES else []
    literal = lambda row: F.struct(*(F.lit(row[c]).cast(df.schema[c].dataType).alias(c) for c in order))
    at = F.size(F.filter(F.array(*map(literal, limits)), lambda x: x <= F.struct(*order))) if limits else F.lit(0)
    ranged = df.withColumn("_range", at)
    before, starts = start, {}
    for r in sorted(ranged.groupBy("_range").count().collect(), key=lambda r: r["_range"]):
        starts[r["_range"]], before = before, before + r["count"]
    if not starts:
        return df.withColumn(name, F.lit(None).cast("long"))
    first = F.element_at(F.create_map(*(F.lit(x) for pair in starts.items() for x in pair)), F.col("_range"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn(name, (first + place - 1).cast("long")).drop("_range")
