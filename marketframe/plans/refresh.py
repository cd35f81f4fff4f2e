"""Full loads and daily updates of each dataset from landed, normalised rows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.operators import universe as pool
from marketframe.operators.dataquality import must_rebuild
from marketframe.operators.normalize import basic_data
from marketframe.operators.relational import first_source
from marketframe.sources.snapshots import DEFAULT_START, Manifest, Table, drifted
from marketframe.specs import DatasetSpec, spec_of

#: Sources in order of priority.
PRIORITY = {"Stock_KData": ["sina", "em", "tx", "bs"], "Stock_Basic_Data": ["bs", "akshare"], "Financial_Indicator": ["em", "nonem"], "Trade_Date": ["exchange", "bs"]}
DIVIDEND_DAYS = 30


@dataclass(frozen=True)
class Summary:
    """What a load did: 'full', 'updated', 'up_to_date' or 'skipped'; its window and rows."""

    type_name: str
    action: str
    start: date | None = None
    end: date | None = None
    rows: int = 0


def due(updated: date, today: date) -> bool:
    """Whether dividends are to be loaded again."""
    return (today - updated).days >= DIVIDEND_DAYS


def ranked(landed: DataFrame, name: str, source: str | None = None) -> DataFrame:
    """Rows of the first source, in the dataset's order, that has any for each code; or those of one named source."""
    if "source" not in landed.columns:
        return landed
    order = PRIORITY.get(spec_of(name).name, [])
    if source is not None:
        return landed.where(F.col("source") == source).drop("source")
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("source")) - 1 if order else F.lit(0)
    known = landed.withColumn("source_rank", F.when(rank >= 0, rank))
    return first_source(known.where("source_rank is not null"), spec_of(name).code_col or "trade_date").drop("source", "source_rank")


def refresh(spark: SparkSession, root: str, name: DatasetSpec | str, landed: DataFrame, today: date, *, full: bool = False, source: str | None = None, default: date = DEFAULT_START) -> Summary:
    """Load what is missing of one dataset.

    full, or never loaded: everything up to today.  Dividends: everything, if 30 days have passed since the last load.  Basic data: all
    of it again if the stored columns drifted or the table is implausibly small; else one day further back than what is missing.
    Others: the window after the last stored day.  Nothing to load: no change.
    """
    spec, table, manifest = spec_of(name), Table(spark, root, name), Manifest(spark, root)
    now = manifest.entry(spec.name)
    start, end = default, today
    fresh = full or now is None or not table.exists()
    if spec.name == "Dividend_History":
        if not fresh and not due(now.updated_at.date(), today):
            return Summary(spec.name, "up_to_date")
        fresh = True
    elif not fresh:
        if spec.name == "Stock_Basic_Data":
            size = pool.size(Table(spark, root, "Universe")._all(), distinct=True)
            fresh = drifted(table) or must_rebuild(now.row_count, size)
        if not fresh:
            start, end = manifest.resume_range(spec.name, today, default)
            if start > end:
                return Summary(spec.name, "up_to_date", start, end)
            if spec.name == "Stock_Basic_Data":
                start -= timedelta(1)
    if spec.time_col and spec.name != "Dividend_History":
        landed = landed.where(F.col(spec.time_col).between(F.lit(start), F.lit(end)))
    rows = ranked(landed, spec.name, source)  # which source has data is asked for the window
    if spec.name == "Stock_Basic_Data":
        rows = basic_data(rows)
    if rows.isEmpty():
        return Summary(spec.name, "skipped", start, end)
    n = table.upsert(rows)
    manifest.update(table)
    return Summary(spec.name, "full" if fresh else "updated", start, end, n)


def load_bars(spark: SparkSession, root: str, landed: DataFrame, today: date, *, full: bool = False, source: str | None = None, spec: DatasetSpec | str = "Stock_KData") -> Summary:
    """Bars of the universe's codes; ValueError if the universe is empty."""
    members = Table(spark, root, "Universe")._all().select("stock_code").distinct()
    if members.isEmpty():
        raise ValueError("the universe is empty; load it first")
    return refresh(spark, root, spec, landed.join(members, "stock_code", "left_semi"), today, full=full, source=source)


def load_universe(spark: SparkSession, root: str, members: DataFrame, position: str | None = None, spec: DatasetSpec | str = "Universe") -> dict[str, int]:
    """Append new members of an index; known ones keep their numbers.  {total, added}; its fingerprint goes into the manifest."""
    table = Table(spark, root, spec)
    old = table._all()
    new = pool.new_members(old, members, position, table.spec.code_form)
    added = table.upsert(new, conflict="ignore") if not new.isEmpty() else 0
    both = table._all()
    Manifest(spark, root).update(table, pool.fingerprint(both).first()[0])
    return {"total": both.count(), "added": added}


def update(spark: SparkSession, root: str, name: DatasetSpec | str, landed: DataFrame, today: date, **options) -> Summary | dict[str, int]:
    """Update by dataset name or declaration; ValueError for an unknown one."""
    spec = spec_of(name)
    if spec.name == "Universe":
        return load_universe(spark, root, landed, spec=spec)
    if spec.name == "Stock_KData":
        return load_bars(spark, root, landed, today, spec=spec, **options)
    return refresh(spark, root, spec, landed, today, **options)
