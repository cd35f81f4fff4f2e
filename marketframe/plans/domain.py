"""Market tables derived from the generic test tables, in Spark and, for comparison, in SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.functions.scalars import zfill6
from marketframe.specs import NUMBERED_CODE, DatasetSpec, spec_of


def code(key: Column) -> Column:
    return F.concat(zfill6(key), F.lit(".SZ"))


def numbered_spec(name: str) -> DatasetSpec:
    """The dataset as the derived tables fill it: their codes are keys, and a key above 999,999 has more than six digits."""
    return replace(spec_of(name), code_form=NUMBERED_CODE)


def _sum(column: str) -> Column:
    """A sum of amounts with two decimals, the same in any order."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


class Domain:
    """The derived tables of one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def bars(self) -> DataFrame:
        """A nearly dense panel: one bar for each user and day."""
        e = self.table("events")
        return e.groupBy(F.to_date("ts").alias("trade_date"), code(F.col("user_id")).alias("stock_code")).agg(
            F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"),
            _sum("value").alias("amount"), F.count("*").cast("double").alias("volume"),
        )

    def basic(self) -> DataFrame:
        e = self.table("events")
        return e.groupBy(F.to_date("ts").alias("trade_date"), code(F.col("user_id")).alias("stock_code")).agg(
            F.round(F.lit(1.0) + F.max(F.dayofmonth("ts")) * F.lit(0.01), 2).alias("adj_factor"), (F.max("user_id") % 10 != 0).alias("is_activate")
        )

    def bars_wide(self) -> DataFrame:
        """A large sparse table: one bar for each part and ship date."""
        li = self.table("lineitem")
        return li.groupBy(F.to_date("l_shipdate").alias("trade_date"), code(F.col("l_partkey")).alias("stock_code")).agg(
            F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"), F.sum("l_quantity").alias("volume"), _sum("l_extendedprice").alias("amount")
        )

    def calendar(self) -> DataFrame:
        return self.table("orders").select(F.to_date("o_orderdate").alias("trade_date")).where(F.weekday("trade_date") < 5).distinct()

    def universe(self) -> DataFrame:
        p = self.table("part")
        listed = F.date_add(F.lit("1995-01-01").cast("date"), F.col("p_partkey").cast("int"))
        return p.select(F.col("p_partkey").alias("stock_index"), code(F.col("p_partkey")).alias("stock_code"), F.col("p_name").alias("stock_name"), F.when(F.col("p_partkey") % 7 != 0, listed).alias("ipo_date"))

    def income(self) -> DataFrame:
        li = self.table("lineitem")
        quarter = F.last_day(F.add_months(F.trunc(F.to_date("l_shipdate"), "quarter"), 2))
        cost = F.sum(F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_discount").cast("decimal(4,2)")).cast("double")
        return li.groupBy(code(F.col("l_suppkey")).alias("stock_code"), quarter.alias("report_date")).agg(_sum("l_extendedprice").alias("total_operate_income"), cost.alias("operate_cost"))

    def dividend(self) -> DataFrame:
        o = self.table("orders")
        return o.groupBy(code(F.col("o_custkey")).alias("stock_code"), F.to_date("o_orderdate").alias("ex_date")).agg(F.round(_sum("o_totalprice") / 1e6, 6).alias("dividend_per_share"))

    def sources(self) -> DataFrame:
        """Three sources that overlap in their codes: line items by return flag."""
        li = self.table("lineitem")
        source = F.when(F.col("l_returnflag") == "R", "sina").when(F.col("l_returnflag") == "A", "em").otherwise("tx")
        return li.groupBy(F.to_date("l_shipdate").alias("trade_date"), code(F.col("l_partkey")).alias("stock_code"), source.alias("source")).agg(F.max("l_extendedprice").alias("high"), F.sum("l_quantity").alias("volume"))

    def upsert_pair(self) -> tuple[DataFrame, DataFrame]:
        """Stored bars before 1998, and incoming ones from 1997 on with their amounts doubled."""
        b = self.bars_wide()
        return b.where("trade_date < date'1998-01-01'"), b.where("trade_date >= date'1997-01-01'").withColumn("amount", F.col("amount") * 2)


_CODE = "(repeat('0', greatest(0, 6 - length(CAST({0} AS VARCHAR)))) || CAST({0} AS VARCHAR) || '.SZ')"


def code_sql(key: str) -> str:
    return _CODE.format(key)


VIEWS = {
    "bars": f"""SELECT CAST(ts AS DATE) trade_date, {code_sql("user_id")} stock_code, min_by(value, event_id) AS open, max(value) high, min(value) low, max_by(value, event_id) AS close,
        CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) amount, CAST(count(*) AS DOUBLE) volume FROM events GROUP BY 1, 2""",
    "basic": f"SELECT CAST(ts AS DATE) trade_date, {code_sql('user_id')} stock_code, round(1 + max(day(ts)) * 0.01e0, 2) adj_factor, max(user_id) % 10 <> 0 is_activate FROM events GROUP BY 1, 2",
    "bars_wide": f"""SELECT CAST(l_shipdate AS DATE) trade_date, {code_sql("l_partkey")} stock_code, max(l_extendedprice) high, min(l_extendedprice) low, sum(l_quantity) volume,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) amount FROM lineitem GROUP BY 1, 2""",
    "calendar": "SELECT DISTINCT CAST(o_orderdate AS DATE) trade_date FROM orders WHERE isodow(o_orderdate) < 6",
    "universe": f"SELECT p_partkey stock_index, {code_sql('p_partkey')} stock_code, p_name stock_name, CASE WHEN p_partkey % 7 <> 0 THEN DATE '1995-01-01' + CAST(p_partkey AS INT) END ipo_date FROM part",
    "income": f"""SELECT {code_sql("l_suppkey")} stock_code, last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) report_date,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) total_operate_income, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) operate_cost FROM lineitem GROUP BY 1, 2""",
    "dividend": f"SELECT {code_sql('o_custkey')} stock_code, CAST(o_orderdate AS DATE) ex_date, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1e6, 6) dividend_per_share FROM orders GROUP BY 1, 2",
    "sources": f"""SELECT CAST(l_shipdate AS DATE) trade_date, {code_sql("l_partkey")} stock_code, CASE l_returnflag WHEN 'R' THEN 'sina' WHEN 'A' THEN 'em' ELSE 'tx' END source, max(l_extendedprice) high, sum(l_quantity) volume
        FROM lineitem GROUP BY 1, 2, 3""",
}


def sql(select: str, *views: str, **more: str) -> str:
    """``select`` with the derived tables (and further ones) in front."""
    parts = [f"{v} AS ({VIEWS[v]})" for v in views] + [f"{k} AS ({v})" for k, v in more.items()]
    return f"WITH {', '.join(parts)} {select}" if parts else select
