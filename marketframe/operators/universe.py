"""The append-only universe of stocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.functions.scalars import is_stock_code
from marketframe.operators.relational import numbered
from marketframe.specs import STOCK_CODE

#: Listing day of a stock that has none.
DEFAULT_IPO = "1990-01-01"
# Index names and their codes.
INDEX_CODES = {"csi1000": "000852", "csi500": "000905", "csi300": "000300", "csi100": "000903", "csi_all": "000985"}
FIELDS = ["stock_index", "stock_code", "stock_name", "ipo_date"]


def loaded(df: DataFrame) -> DataFrame:
    """The universe's columns; ValueError if the index, code or name is missing.  ipo_date may be absent."""
    missing = sorted({"stock_index", "stock_code", "stock_name"} - set(df.columns))
    if missing:
        raise ValueError(f"the universe lacks {', '.join(missing)}")
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("date").alias(c) for c in FIELDS))


def new_members(universe: DataFrame, members: DataFrame, position: str | None = None, code_form: str = STOCK_CODE) -> DataFrame:
    """Members whose code is not there yet, each once, numbered on from the largest index in order of position (else code).

    Indexes are never reused.  Codes that do not match ``code_form`` are left out.  Members are numbered range by range.
    """
    fresh = members.where(is_stock_code(F.col("stock_code"), code_form)).join(universe.select("stock_code").distinct(), "stock_code", "left_anti")
    at = F.col(position) if position else F.col("stock_code")
    rest = [F.min_by(c, at).alias(c) if c in members.columns else F.lit(None).cast(t).alias(c) for c, t in (("stock_name", "string"), ("ipo_date", "date"))]
    fresh = fresh.groupBy("stock_code").agg(F.min(at).alias("_at"), *rest)
    base = universe.agg(F.coalesce(F.max("stock_index") + 1, F.lit(0))).first()[0]
    return numbered(fresh, ["_at", "stock_code"], "stock_index", base).select(FIELDS)


def grown(universe: DataFrame, members: DataFrame, position: str | None = None, code_form: str = STOCK_CODE) -> DataFrame:
    """The universe with its new members; known ones keep their index."""
    return universe.select(FIELDS).unionByName(new_members(universe, members, position, code_form))


def is_active(asof: Column) -> Column:
    """Listed on or before a day; no listing day counts as ``DEFAULT_IPO``."""
    return F.coalesce(F.col("ipo_date"), F.lit(DEFAULT_IPO).cast("date")) <= asof


def active_mask(universe: DataFrame, asof: str) -> DataFrame:
    return universe.select("stock_index", "stock_code", is_active(F.lit(asof).cast("date")).alias("is_active")).orderBy("stock_index")


def active_count(universe: DataFrame, asof: str) -> DataFrame:
    return universe.agg(F.count_if(is_active(F.lit(asof).cast("date"))).alias("n_active"))


def fingerprint(universe: DataFrame) -> DataFrame:
    """One row: 16 hex digits of the sorted codes joined by ``|``."""
    return universe.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("stock_code")), "|"), 256), 1, 16).alias("universe_sha"))


def index_of(df: DataFrame, universe: DataFrame) -> DataFrame:
    """``df`` with the stock_index of its stock_code; null if unknown."""
    return df.join(universe.select("stock_code", "stock_index"), "stock_code", "left")


def code_of(df: DataFrame, universe: DataFrame) -> DataFrame:
    """``df`` with the stock_code of its stock_index; null if unknown."""
    return df.join(universe.select("stock_index", "stock_code"), "stock_index", "left")


def size(universe: DataFrame, distinct: bool = False) -> int:
    """All rows ever, or distinct codes."""
    return universe.select("stock_code").distinct().count() if distinct else universe.count()


def export(universe: DataFrame) -> DataFrame:
    return universe.select(FIELDS).orderBy("stock_index")
