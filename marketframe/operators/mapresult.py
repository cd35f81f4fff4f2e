"""Map a user function over rows without losing the job to one bad row."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator, Sequence
from itertools import chain
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ``map_combine`` deals out a code that has more rows than this; another is one share.
SHARE_ROWS = 10_000


def map_with_result(df: DataFrame, fn: Callable, inputs: Sequence[str], returns: str, position: str) -> DataFrame:
    """position, success, value, error, traceback for every row: ``fn`` of the input columns, as separate arguments.

    An exception is a row with success false; the others go on.  Order the result by ``position`` to have the input's order.
    """
    kind = df.schema[position].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for at, *args in part.itertuples(index=False, name=None):
                try:
                    rows.append((at, True, fn(*args), None, None))
                except Exception as e:  # what the user's function raises is a result here
                    rows.append((at, False, None, f"{type(e).__name__}: {e}", traceback.format_exc()))
            yield pd.DataFrame(rows, columns=[position, "success", "value", "error", "traceback"], dtype=object)

    return df.select(F.col(position).alias("_position"), *inputs).mapInPandas(run, f"`{position}` {kind}, success boolean, value {returns}, error string, traceback string")


def successes(result: DataFrame) -> DataFrame:
    return result.where("success").select(*(c for c in result.columns if c not in ("success", "error", "traceback")))


def failures(result: DataFrame) -> DataFrame:
    return result.where("not success")


def summary(result: DataFrame, position: str, shown: int = 3) -> DataFrame:
    """One row: n_ok, n_failed, n_total, and the first errors by position."""
    first = F.transform(F.slice(F.array_sort(F.collect_list(F.struct(position, "error"))), 1, shown), lambda x: x["error"])
    errors = result.where("not success").orderBy(position).limit(shown).agg(first.alias("first_errors"))
    counts = result.agg(F.count_if("success").alias("n_ok"), F.count_if(~F.col("success")).alias("n_failed"), F.count("*").alias("n_total"))
    return counts.withColumn("_one", F.lit(1)).join(errors.withColumn("_one", F.lit(1)), "_one").drop("_one")


def first_by(df: DataFrame, group: str, value: str, shown: int, name: str) -> DataFrame:
    """group and ``name``: the ``shown`` smallest values of each group in order.  Each task keeps that many of a group, then one keeps them of
    all tasks; no group is gathered."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(value))
    few = df.select(group, value).withColumn("_at", place).where(F.col("_at") <= shown)
    return few.groupBy(group).agg(F.array_sort(F.collect_list(value)).alias(name))  # at most ``shown``


def all_by(df: DataFrame, group: str, code: str, name: str) -> DataFrame:
    """group and ``name``: all codes of each group in order, nulls last, repeats included.  Tasks sort the pieces of a group that start with
    the same three characters; who puts them in a row only strings sorted pieces together."""
    piece = df.groupBy(group, F.substring(code, 1, 3).alias("_piece")).agg(F.array_sort(F.collect_list(code)).alias("_codes"), F.count_if(F.col(code).isNull()).alias("_none"))
    whole = piece.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_piece", "_codes"))).alias("_pieces"), F.sum("_none").cast("int").alias("_none"))
    return whole.select(group, F.concat(F.flatten("_pieces._codes"), F.array_repeat(F.lit(None).cast("string"), F.col("_none"))).alias(name))


def tally(df: DataFrame, group: str, success: str, rows: str, code: str, shown: int | None = 5) -> DataFrame:
    """Per group: n_ok, n_failed, total_rows, and the ``shown`` first failed codes in order, or all of them with None (``failed`` lists them
    as rows)."""
    counts = df.groupBy(group).agg(F.count_if(F.col(success)).alias("n_ok"), F.count_if(~F.col(success)).alias("n_failed"), F.sum(rows).alias("total_rows"))
    bad = df.where(~F.col(success))
    codes = all_by(bad, group, code, "failed_codes") if shown is None else first_by(bad, group, code, shown, "failed_codes")
    codes = codes.withColumnRenamed(group, "_group")
    met = counts.join(codes, counts[group].eqNullSafe(codes["_group"]), "left").drop("_group")
    return met.withColumn("failed_codes", F.coalesce("failed_codes", F.array().cast(codes.schema["failed_codes"].dataType)))


def failed(df: DataFrame, code: str, success: str) -> DataFrame:
    """A row for each code that failed, with how often: the form for any number of codes (``tally`` shows the first)."""
    return df.where(~F.col(success)).groupBy(code).agg(F.count("*").alias("n_failed"))


def _guarded(fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], columns: list[str]) -> Callable:
    """``fn`` over a group's frames; what it raises becomes a row with the error, after the rows it gave before."""

    def run(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = True
        try:
            for made in fn(parts):
                none &= not len(made)
                yield pd.DataFrame({c: made[c] for c in columns} | {"_code": key[0], "_error": None})
            error = "no rows" if none else None
        except _ShareError as e:
            error = str(e)
        except Exception as e:  # a failing item is listed, not fatal
            error = f"{type(e).__name__}: {e}"
        if error:
            yield pd.DataFrame([[None] * len(columns) + [key[0], error]], columns=[*columns, "_code", "_error"], dtype=object)

    run.__annotations__ = {"key": tuple[Any, ...], "parts": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    return run


def map_batches(df: DataFrame, code: str, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows that ``fn`` makes of each code's frames, problems: code and error).

    A code's rows come as an iterator of frames, in no stated order, and what ``fn`` yields goes on at once, so memory holds a few frames
    whatever a code has.  A code whose call raises is a problem with the error, and none of its rows count; one that gives no rows has the
    error 'no rows'.
    """
    return _mapped(df, [code], fn, schema)


def _mapped(df: DataFrame, by: list[str], fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    return _split(_called(df, by, fn, schema), by[0], schema)


def _called(df: DataFrame, by: list[str], fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: T.StructType) -> DataFrame:
    """What ``fn`` makes of each group, with the group's first key as ``_code``; a failed group has a row with ``_error``.

    Calls cost far more than bytes, so groups are dealt to a stated number of tasks: Spark merges no small ones then.
    """
    out = T.StructType([*schema.fields, T.StructField("_code", df.schema[by[0]].dataType), T.StructField("_error", T.StringType())])
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *by).groupBy(*by).applyInPandas(_guarded(fn, schema.names), out)


def _split(made: DataFrame, code: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    problems = made.where("_error is not null").select(F.col("_code").alias(code), F.col("_error").alias("error"))
    bad = problems.where("error <> 'no rows'").select(F.col(code).alias("_bad"))
    rows = made.where("_error is null").join(bad, F.col("_code").eqNullSafe(F.col("_bad")), "left_anti").select(*schema.names)
    return rows, problems


def map_combine(df: DataFrame, code: str, part: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], partial: T.StructType, combine: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: T.StructType, parts: int = 16) -> tuple[DataFrame, DataFrame]:
    """``map_batches`` for codes that may hold any share of the rows: ``part`` sees one of ``parts`` shares of a code (dealt by a hash of the
    row; a code of at most ``SHARE_ROWS`` rows is one share), ``combine`` the rows of type ``partial`` that all its shares gave.  ``partial``
    must have the code's column.  What ``part`` raised goes with its rows to the task that combines them, so each function is called once a group
    for the problems; ``combine`` may be called for a code of which a share failed, and its rows do not count then.
    """
    large = df.groupBy(F.col(code).alias("_large")).count().where(F.col("count") > SHARE_ROWS).drop("count").withColumn("_is_large", F.lit(True))
    dealt = df.join(F.broadcast(large), df[code].eqNullSafe(large["_large"]), "left").withColumn("_share", F.when(F.col("_is_large"), F.pmod(F.xxhash64(*(df[c] for c in df.columns)), F.lit(parts))).otherwise(0))
    some = _called(dealt.select(*df.columns, "_share"), [code, "_share"], part, partial)
    some = some.withColumn("_code", F.when(F.col("_error").isNull(), F.col(code)).otherwise(F.col("_code")))
    whole = [f for f in partial if isinstance(f.dataType, T.IntegralType | T.BooleanType)]  # a null beside them would make them floats in pandas
    some = some.withColumns({f.name: F.when(F.col("_error").isNull(), F.col(f.name)).otherwise(F.lit(0).cast(f.dataType)) for f in whole})
    rows, problems = _split(_called(some, ["_code"], _of_shares(combine, partial.names), schema), "_code", schema)
    return rows, problems.withColumnRenamed("_code", code)


class _ShareError(Exception):
    """The error of a share, as text."""


def _of_shares(combine: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], columns: list[str]) -> Callable:
    """``combine`` over the rows that shares gave; an error of a share, the least if there are several, stands before its own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        errors: set[str] = set()

        def given() -> Iterator[pd.DataFrame]:
            for f in frames:
                bad = f["_error"].notna()
                if bad.any():
                    errors.update(e for e in f.loc[bad, "_error"].unique() if e != "no rows")
                    f = f[~bad].reset_index(drop=True)
                if len(f):
                    yield f.iloc[:, : len(columns)]

        rest = given()
        first = next(rest, None)
        if first is not None:
            try:
                yield from combine(chain([first], rest))
            except Exception:
                for _ in rest:  # an error of a share may still come
                    pass
                if not errors:
                    raise
            for _ in rest:
                pass
        if errors:
            raise _ShareError(min(errors))

    return run


def map_tables(df: DataFrame, code: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows that ``fn`` makes of each code's rows, codes whose call failed or gave no rows)."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        try:
            return fn(part)[schema.names]
        except Exception:  # a failing item is listed, not fatal
            return pd.DataFrame(columns=schema.names)

    made = df.groupBy(code).applyInPandas(one, schema)
    return made, df.select(code).distinct().join(made.select(code).distinct(), code, "left_anti")
