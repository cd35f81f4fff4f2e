"""Keyed datasets: schema, key, frequency and version of each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: The form of a code: nine characters with ``.SH`` or ``.SZ`` at the end.
STOCK_CODE = r"^.{6}\.(SH|SZ)$"
#: The same, or a number above 999,999 in full instead of six characters: what tables coded by running numbers have.
NUMBERED_CODE = r"^(.{6}|[1-9][0-9]{6,})\.(SH|SZ)$"

_TYPES = {"date": T.DateType(), "str": T.StringType(), "num": T.DoubleType(), "int": T.LongType(), "bool": T.BooleanType()}


@dataclass(frozen=True)
class DatasetSpec:
    """One keyed table.  ``time_col`` is what coverage and resume windows look at; None for tables without time.  ``code_form``: what codes match."""

    name: str
    schema: T.StructType
    key: tuple[str, ...]
    frequency: str
    format: str = "parquet"
    version: str = "1.0"
    time_col: str | None = None
    code_col: str | None = "stock_code"
    code_form: str = STOCK_CODE

    @property
    def columns(self) -> list[str]:
        return self.schema.names


def _schema(**kinds: str) -> T.StructType:
    """Fields and their kinds, in order."""
    return T.StructType([T.StructField(n, _TYPES[k]) for n, k in kinds.items()])


def _numbers(names: list[str]) -> dict[str, str]:
    return dict.fromkeys(names, "num")


# The datasets' fields, in their order.
INCOME = [
    "total_operate_income", "operate_income", "total_operate_cost", "operate_cost", "sale_expense", "manage_expense",
    "finance_expense", "research_expense", "operate_profit", "total_profit", "income_tax", "netprofit",
    "parent_netprofit", "minority_netprofit", "basic_eps", "diluted_eps",
]
BALANCE = [
    "total_assets", "total_current_assets", "cash_equivalent", "account_receivable", "inventory",
    "total_noncurrent_assets", "fixed_asset", "goodwill", "total_liability", "total_current_liability", "short_loan",
    "account_payable", "total_noncurrent_liability", "long_loan", "bond_payable", "total_equity", "parent_equity",
    "minority_equity", "capital_reserve", "surplus_reserve", "retained_earnings",
]
CASHFLOW = [
    "operate_cash_flow_net", "sale_service_cash", "buy_service_cash", "invest_cash_flow_net", "invest_pay_cash",
    "finance_cash_flow_net", "borrow_cash", "repay_debt_cash", "dividend_pay_cash", "cash_net_increase",
    "cash_end_period", "cash_begin_period",
]
INDICATOR = [
    "eps", "bvps", "roe_weighted", "gross_margin", "net_margin", "revenue_yoy", "netprofit_yoy", "debt_asset_ratio",
    "pe_ttm", "pb",
]
_DAY, _QUARTER = ("trade_date", "stock_code"), ("stock_code", "report_date")


def _report(name: str, amounts: list[str]) -> DatasetSpec:
    return DatasetSpec(name, _schema(stock_code="str", report_date="date", **_numbers(amounts), update_time="str"), _QUARTER, "quarterly", time_col="report_date")


REGISTRY: dict[str, DatasetSpec] = {
    s.name: s
    for s in (
        DatasetSpec("Stock_KData", _schema(trade_date="date", stock_code="str", **_numbers(["open", "high", "low", "close", "amount", "volume"])), _DAY, "daily", time_col="trade_date"),
        DatasetSpec("Stock_Basic_Data", _schema(trade_date="date", stock_code="str", adj_factor="num", limit_upper_price="num", limit_lower_price="num", sw_industry="str", total_share="num", turnover="num", is_activate="bool"), _DAY, "daily", time_col="trade_date"),
        DatasetSpec("Trade_Date", _schema(trade_date="date"), ("trade_date",), "daily", format="csv", time_col="trade_date", code_col=None),
        DatasetSpec("Universe", _schema(stock_index="int", stock_code="str", stock_name="str", ipo_date="date"), ("stock_index",), "static", format="csv"),
        _report("Financial_Report_Income", INCOME),
        _report("Financial_Report_Balance", BALANCE),
        _report("Financial_Report_Cashflow", CASHFLOW),
        _report("Financial_Indicator", INDICATOR),
        DatasetSpec("Dividend_History", _schema(stock_code="str", ex_date="date", record_date="date", pay_date="date", report_date="date", **_numbers(["dividend_per_share", "share_bonus_per_share", "share_dividend_per_share"]), update_time="str"), ("stock_code", "ex_date"), "static", time_col="ex_date"),
    )
}
ALIASES = {"TradeDate": "Trade_Date"}


def spec_of(name: DatasetSpec | str) -> DatasetSpec:
    """The dataset of that name, or the one that is given; ValueError if there is none."""
    if isinstance(name, DatasetSpec):
        return name
    try:
        return REGISTRY[ALIASES.get(name, name)]
    except KeyError:
        raise ValueError(f"no dataset {name!r}; there are {', '.join(REGISTRY)}") from None
