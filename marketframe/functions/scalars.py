"""Codes, dates, numbers, fingerprints and versions as column expressions.

Null in, null out, unless stated.  Nothing here raises on bad data: what can't be read becomes null.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketframe.specs import STOCK_CODE


def zfill6(code: Column) -> Column:
    """Zero-padded to six characters; longer values stay as they are."""
    text = F.trim(code.cast("string"))
    return F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)


def to_full_stock_code(code: Column, strict: bool = False) -> Column:
    """Six digits (padded) to the nine-character form: 6 to ``.SH``, 0 and 3 to ``.SZ``; anything else null, an error if ``strict``."""
    six = zfill6(code)
    full = F.when(six.rlike("^6[0-9]{5}$"), F.concat(six, F.lit(".SH"))).when(six.rlike("^[03][0-9]{5}$"), F.concat(six, F.lit(".SZ")))
    return F.coalesce(full, F.raise_error(F.concat(F.lit("not a stock code: "), F.coalesce(six, F.lit("null")))).cast("string")) if strict else full


def bare_code(code: Column) -> Column:
    """``600000`` of ``600000.SH``."""
    return F.split_part(code, F.lit("."), F.lit(1))


def vendor_code(code: Column, form: str) -> Column:
    """A nine-character code as vendors write it: 'SH600000', 'sh.600000' or 'sh600000'."""
    bare, place = bare_code(code), F.split_part(code, F.lit("."), F.lit(2))
    if form == "SH600000":
        return F.concat(place, bare)
    if form == "sh.600000":
        return F.concat(F.lower(place), F.lit("."), bare)
    if form == "sh600000":
        return F.concat(F.lower(place), bare)
    raise ValueError(f"unknown code form {form!r}")


def from_dotted_code(code: Column) -> Column:
    """``600000.SH`` of ``sh.600000``; without a dot unchanged."""
    return F.when(F.instr(code, ".") > 0, F.concat(F.split_part(code, F.lit("."), F.lit(2)), F.lit("."), F.upper(F.split_part(code, F.lit("."), F.lit(1))))).otherwise(code)


def to_day(value: Column) -> Column:
    """A date from a date, timestamp, or date or datetime text; unparseable is null."""
    text = value.cast("string")
    return F.coalesce(F.try_to_timestamp(text).cast("date"), F.substring(text, 1, 10).try_cast("date"))


def compact_day(day: Column, default: str | None = None) -> Column:
    """``YYYYMMDD``; null is ``default``, as it stands."""
    return F.coalesce(F.date_format(day, "yyyyMMdd"), F.lit(default))


def to_number(value: Column) -> Column:
    """A double; what is no number, and NaN, is null."""
    return F.nanvl(value.try_cast("double"), F.lit(None).cast("double"))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN is null in every float column."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")).cast(df.schema[c].dataType) for c in floats}) if floats else df


def is_stock_code(code: Column, form: str = STOCK_CODE) -> Column:
    """Nine characters with ``.SH`` or ``.SZ`` at the end, or another form; null is false."""
    return F.coalesce(code.rlike(form), F.lit(False))


def is_iso_day(text: Column) -> Column:
    """``YYYY-MM-DD`` and a day that exists; null is false."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & text.try_cast("date").isNotNull(), F.lit(False))


def is_clock(text: Column) -> Column:
    """``HH:MM`` from 00:00 to 23:59; null is false."""
    return F.coalesce(text.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), F.lit(False))


def parse_day(text: Column) -> Column:
    """A date of ISO text in the strict form; else null."""
    return F.when(is_iso_day(text), text.try_cast("date"))


def format_day(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def shift_days(day: Column, days: int) -> Column:
    """So many natural days later; earlier if negative."""
    return F.date_add(day, days)


def resume_day(last: Column, latest: Column) -> Column:
    """The first day still to be loaded: the day after the last one, or after ``latest`` if that is earlier."""
    return F.date_add(F.least(last, latest), 1)


def is_due(last: Column, today: Column, days: int) -> Column:
    """Whether so many days have passed."""
    return F.datediff(today, last) >= days


def last_day_of(year: Column, month: Column) -> Column:
    return F.last_day(F.make_date(year, month, F.lit(1)))


def hash_sum(columns: list[str]) -> Column:
    """The sum of row hashes: it adds up over parts of a table, and rows can be taken off."""
    return F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row, one column ``fingerprint``: 16 hex digits that depend on the rows (and how often each is there), not on their order."""
    return df.agg(F.substring(F.sha2(F.concat_ws("|", hash_sum(df.columns).cast("string"), F.count("*").cast("string")), 256), 1, 16).alias("fingerprint"))


def fingerprint_of(total: int, rows: int) -> str:
    """The fingerprint of a table whose hash sum and count are known."""
    return hashlib.sha256(f"{total}|{rows}".encode()).hexdigest()[:16]


def version_parts(version: Column) -> Column:
    """The dotted parts as integers, what is none as 0; such arrays compare as versions do."""
    return F.transform(F.split(version, "[.]"), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1; "1" comes before "1.0"."""
    x, y = version_parts(a), version_parts(b)
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def version_key(version: str) -> tuple[int, ...]:
    """The same parts of one version on the driver."""
    return tuple(int(p) if re.fullmatch(r"[+-]?[0-9]+", p) else 0 for p in version.split("."))
