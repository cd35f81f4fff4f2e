"""Landed vendor tables in the datasets' own columns.  Projections only: no shuffle, no Python on rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.functions.scalars import from_dotted_code, to_day, to_full_stock_code, to_number
from marketframe.operators.universe import INDEX_CODES
from marketframe.specs import BALANCE, CASHFLOW, INCOME, INDICATOR, spec_of

BAR_FIELDS = ["open", "high", "low", "close", "amount", "volume"]
# What vendors call their columns.
_BARS = {"日期": "trade_date", "date": "trade_date", "股票代码": "_code", "code": "_code", "开盘": "open", "收盘": "close", "最高": "high", "最低": "low", "成交量": "volume", "成交额": "amount"}
_INDICATORS = {
    "eps": ["EPSJB", "EPSKCJB", "EPSJB_SY"], "bvps": ["BPS", "MGJYXJJE"], "roe_weighted": ["ROEJQ"], "gross_margin": ["XSMLL"], "net_margin": ["XSJLL"], "revenue_yoy": ["TOTAL_OPERATE_INCOME_YOY", "YYSR_YOY", "ZGYSR"],
    "netprofit_yoy": ["PARENT_NETPROFIT_YOY", "ZGMGJYXJJE"], "debt_asset_ratio": ["ZCFZL", "LD"], "pe_ttm": ["PETFMC"], "pb": ["PBMRQ"],
}
_INDICATORS_PERCENT = {
    "日期": "report_date", "加权每股收益(元)": "eps", "每股净资产_调整后(元)": "bvps", "加权净资产收益率(%)": "roe_weighted", "销售毛利率(%)": "gross_margin", "销售净利率(%)": "net_margin",
    "主营业务收入增长率(%)": "revenue_yoy", "净利润增长率(%)": "netprofit_yoy", "资产负债率(%)": "debt_asset_ratio",
}
PERCENT = ["roe_weighted", "gross_margin", "net_margin", "revenue_yoy", "netprofit_yoy", "debt_asset_ratio"]
_DIVIDENDS = {"实施方案公告日期": "report_date", "除权日": "ex_date", "股权登记日": "record_date", "派息日": "pay_date", "派息比例": "dividend_per_share", "送股比例": "share_bonus_per_share", "转增比例": "share_dividend_per_share"}
LISTED = "上市"


def renamed(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Columns under their new names; names that are absent are passed over, and a new name that is there already stays."""
    taken = set(df.columns)
    return df.withColumnsRenamed({a: b for a, b in mapping.items() if a in taken and b not in taken})


def ensured(df: DataFrame, columns: Sequence[str], kind: str = "double") -> DataFrame:
    """Absent columns as nulls."""
    return df.withColumns({c: F.lit(None).cast(kind) for c in columns if c not in df.columns}) if set(columns) - set(df.columns) else df


def numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as doubles: absent or unreadable is null."""
    return ensured(df, columns, "string").withColumns({c: to_number(F.col(c)) for c in columns})


def _within(df: DataFrame, start: str | None, end: str | None, column: str = "trade_date") -> DataFrame:
    if start:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    return df.where(F.col(column) <= F.lit(end).cast("date")) if end else df


def _bars(raw: DataFrame, code: Column | None, of_row, start: str | None, end: str | None) -> DataFrame:
    df = renamed(raw, _BARS)
    if "trade_date" not in df.columns:
        raise ValueError(f"no date column among {raw.columns}")
    own = of_row(F.col("_code")) if "_code" in df.columns else code
    if own is None and "stock_code" not in df.columns:
        raise ValueError("no code column, and no code given")
    df = numbers(df.withColumn("stock_code", own if own is not None else F.col("stock_code")).withColumn("trade_date", to_day(F.col("trade_date"))), BAR_FIELDS)
    return _within(df.select(spec_of("Stock_KData").columns), start, end)


def bars_a(raw: DataFrame, code: str | None = None, *, start: str | None = None, end: str | None = None) -> DataFrame:
    """Daily bars of the first family: Chinese or English names, six-digit codes in a column or ``code`` for all rows.

    Bad numbers are null, absent ones null columns; no date column is an error.  Optional closed range afterwards.
    """
    return _bars(raw, None if code is None else F.lit(code), to_full_stock_code, start, end)


def bars_b(raw: DataFrame, code: str | None = None, *, start: str | None = None, end: str | None = None) -> DataFrame:
    """Daily bars of the second family: codes like ``sh.600000``.  An empty input is an error."""
    if raw.isEmpty():
        raise ValueError("no bars were landed")
    return _bars(raw, None if code is None else F.lit(code), from_dotted_code, start, end)


def adj_factor_a(raw: DataFrame, *, start: str | None = None, end: str | None = None) -> DataFrame:
    """trade_date, stock_code, adj_factor: the column itself, else hfq_close (or close_hfq) / close, null where close is 0."""
    after = next((c for c in ("hfq_close", "close_hfq") if c in raw.columns), None)
    if "adj_factor" in raw.columns:
        factor = to_number(F.col("adj_factor"))
    elif after and "close" in raw.columns:
        factor = F.try_divide(to_number(F.col(after)), to_number(F.col("close")))
    else:
        raise ValueError("neither a factor nor adjusted and plain closes")
    df = renamed(raw, {"date": "trade_date", "日期": "trade_date"})
    return _within(df.select(to_day(F.col("trade_date")).alias("trade_date"), "stock_code", factor.alias("adj_factor")), start, end)


def adj_factor_b(raw: DataFrame, *, start: str | None = None, end: str | None = None) -> DataFrame:
    """The same of tradeDate, code, adjustFactor."""
    df = raw.select(to_day(F.col("tradeDate")).alias("trade_date"), from_dotted_code(F.col("code")).alias("stock_code"), to_number(F.col("adjustFactor")).alias("adj_factor"))
    return _within(df, start, end)


def adj_factor_panel(parts: Sequence[DataFrame]) -> DataFrame:
    """Factors of many sources in order of day and code; none gives an empty typed table."""
    if not parts:
        return SparkSession.active().createDataFrame([], "trade_date date, stock_code string, adj_factor double")
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.orderBy("trade_date", "stock_code")


def trade_dates_flagged(raw: DataFrame) -> DataFrame:
    """Sessions of a table of natural days (calendar_date, is_trading_day): those with 1."""
    df = renamed(raw, {"calendar_date": "trade_date", "is_trading_day": "is_trade_date"})
    return df.where(F.col("is_trade_date").try_cast("int") == 1).select(to_day(F.col("trade_date")).alias("trade_date")).orderBy("trade_date")


def trade_dates_listed(raw: DataFrame, start: str, end: str, column: str = "session") -> DataFrame:
    """Sessions of a list within a closed range; none if start is after end."""
    return _within(raw.select(to_day(F.col(column)).alias("trade_date")), start, end).distinct().orderBy("trade_date")


def constituents(raw: DataFrame, index: str) -> DataFrame:
    """stock_code, stock_name of one index's members; ValueError for an unknown index name or missing columns."""
    if index not in INDEX_CODES:
        raise ValueError(f"unknown index {index!r}; there are {', '.join(INDEX_CODES)}")
    df = renamed(raw, {"成分券代码": "code", "成分券名称": "name", "指数代码": "index_code"})
    if missing := [c for c in ("code", "name") if c not in df.columns]:
        raise ValueError(f"constituents lack {', '.join(missing)}")
    if "index_code" in df.columns:
        df = df.where(F.col("index_code").cast("string") == INDEX_CODES[index])
    return df.select(to_full_stock_code(F.col("code")).alias("stock_code"), F.col("name").alias("stock_name"))


STATEMENTS = {"income": ("Financial_Report_Income", INCOME), "balance": ("Financial_Report_Balance", BALANCE), "cashflow": ("Financial_Report_Cashflow", CASHFLOW)}


def statement(raw: DataFrame, kind: str, code: Column | str | None = None) -> DataFrame:
    """A financial statement: vendor names are ours in capitals; absent columns are null; update_time stays text, null if missing."""
    if kind not in STATEMENTS:
        raise ValueError(f"kind is one of {', '.join(STATEMENTS)}, not {kind!r}")
    name, amounts = STATEMENTS[kind]
    df = renamed(raw, {c.upper(): c for c in [*amounts, "report_date", "update_time"]})
    own = F.lit(code) if isinstance(code, str) else code if code is not None else F.col("stock_code")
    df = ensured(numbers(df, amounts), ["update_time"], "string").withColumn("stock_code", own).withColumn("report_date", to_day(F.col("report_date")))
    stamp = F.col("update_time").cast("string")
    return df.withColumn("update_time", F.when(~F.lower(stamp).isin("nan", "nat", ""), stamp)).select(spec_of(name).columns)


def indicators(raw: DataFrame) -> DataFrame:
    """Indicators of the first vendor: of several names for one field the first that has a value."""
    df = renamed(raw, {"REPORT_DATE": "report_date", "UPDATE_TIME": "update_time"})
    fields = {f: F.coalesce(*(to_number(F.col(c)) for c in names if c in df.columns), F.lit(None).cast("double")) for f, names in _INDICATORS.items()}
    df = ensured(df, ["update_time"], "string").withColumns(fields).withColumn("report_date", to_day(F.col("report_date")))
    return df.select(spec_of("Financial_Indicator").columns)


def indicators_percent(raw: DataFrame) -> DataFrame:
    """Indicators of the second vendor: percentages become ratios; pe_ttm and pb are null."""
    df = numbers(renamed(raw, _INDICATORS_PERCENT), INDICATOR)
    df = df.withColumns({c: F.col(c) / 100 for c in PERCENT} | {"report_date": to_day(F.col("report_date")), "pe_ttm": F.lit(None).cast("double"), "pb": F.lit(None).cast("double")})
    return ensured(df, ["update_time"], "string").select(spec_of("Financial_Indicator").columns)


def dividends(raw: DataFrame, ingested: Column | None = None) -> DataFrame:
    """Dividends: four dates, three amounts, update_time = when they were taken in."""
    df = numbers(renamed(raw, _DIVIDENDS), ["dividend_per_share", "share_bonus_per_share", "share_dividend_per_share"])
    days = ["ex_date", "record_date", "pay_date", "report_date"]
    df = ensured(df, days, "date").withColumns({c: to_day(F.col(c)) for c in days})
    stamp = F.current_timestamp() if ingested is None else ingested
    return df.withColumn("update_time", stamp.cast("string")).select(spec_of("Dividend_History").columns)


def basic_data(factors: DataFrame) -> DataFrame:
    """A factor table completed to Stock_Basic_Data: other attributes null, is_activate true."""
    spec = spec_of("Stock_Basic_Data")
    have = set(factors.columns)
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else (F.lit(True) if f.name == "is_activate" else F.lit(None)).cast(f.dataType).alias(f.name) for f in spec.schema]
    return factors.select(*cols)


def ipo_dates(info: DataFrame) -> DataFrame:
    """stock_code, ipo_date of rows (stock_code, item, value): the value of the item that speaks of listing, or of ipoDate."""
    said = info.where(F.col("item").contains(LISTED) | F.col("value").contains(LISTED) | (F.col("item") == "ipoDate"))
    value = F.when(F.col("value").contains(LISTED), F.col("item")).otherwise(F.col("value"))
    return said.groupBy("stock_code").agg(F.min_by(to_day(F.substring(value, 1, 10)), "item").alias("ipo_date"))
