"""Dense date x stock panels, returns along the session axis, and wide shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ["open", "high", "low", "close", "volume"]
MATRIX = [*FIELDS, "adj_close"]
#: Dates and codes of a tile of the matrix.
TILE = (64, 128)


class Panel:
    """Bars on the grid of all their dates and codes: t, trade_date, n, stock_code, the fields, adj_close.

    ``codes``: the columns, in that order; none or an empty list means every code, ascending.  Dates are those that the selection has.
    A cell without a bar is null.  adj_close is the bars' own column of that name, else their close.  A day and code that occur twice
    are an error: at once if ``checked``, else when the rows are computed.
    """

    def __init__(self, bars: DataFrame, codes: Sequence[str] | None = None, *, checked: bool = False) -> None:
        if checked and bars.groupBy("trade_date", "stock_code").count().where("count > 1").limit(1).count():
            raise ValueError("a day and code occur more than once")
        self._named = bool(codes)
        if codes:
            bars = bars.where(F.col("stock_code").isin(list(codes)))
            rows = [(k, c) for k, c in enumerate(codes)]
            self.stocks = bars.sparkSession.createDataFrame(rows, "n long, stock_code string")
        else:
            # one row for each code or date: the two axes are the only frames numbered without a partition
            self.stocks = bars.select("stock_code").distinct().select((F.row_number().over(Window.orderBy("stock_code")) - 1).cast("long").alias("n"), "stock_code")
        at = Window.orderBy("trade_date")
        size = F.count("*").over(at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        self.dates = bars.select("trade_date").distinct().select((F.row_number().over(at) - 1).cast("long").alias("t"), "trade_date", size.alias("size"))
        fields = [F.col(c).cast("double").alias(c) if c in bars.columns else F.lit(None).cast("double").alias(c) for c in FIELDS]
        adj = F.col("adj_close") if "adj_close" in bars.columns else F.col("close") if "close" in bars.columns else F.lit(None)
        self.bars = bars.select("trade_date", "stock_code", *fields, adj.cast("double").alias("adj_close"))

    def _observed(self) -> DataFrame:
        """Bars with t, n and ``size``, the length of the date axis; one more row, without t, for each code that has no bar."""
        placed = self.bars.join(self.dates, "trade_date").join(self.stocks, "stock_code")
        placed = placed.select("n", "stock_code", "t", "trade_date", "size", *MATRIX)
        none = self.stocks.join(self.bars.select("stock_code").distinct(), "stock_code", "left_anti") if self._named else None
        if none is None:
            return placed
        size = self.dates.where("t = 0").select(F.col("t").alias("_first"), "size")  # one row, or none
        none = none.withColumn("_first", F.lit(0).cast("long")).join(size, "_first")
        return placed.unionByName(none.select("n", "stock_code", "size"), allowMissingColumns=True)

    def _cells(self, value: Column | None = None) -> DataFrame:
        """Every cell of the grid.  One shuffle, on the code: a window over a code's bars sees the place of the bar before and after, and a
        bar brings forth the empty cells between it and the next; nothing is gathered.  ``value``: a column over that window."""
        by = Window.partitionBy("n", "stock_code").orderBy("t")
        before, after = F.lag("t").over(by), F.lead("t").over(by)
        again = F.when(before == F.col("t"), F.raise_error(F.concat(F.lit("a day and code occur more than once: "), "stock_code")).cast("long"))
        start = F.when(before.isNull(), F.lit(0).cast("long")).otherwise(F.col("t"))
        seen = self._observed().withColumns({"_start": F.coalesce(again, F.coalesce(start, F.lit(0).cast("long"))), "_end": F.coalesce(after, "size") - 1} | ({} if value is None else {"ret": value}))
        own = [*MATRIX, *([] if value is None else ["ret"])]
        places = F.when(F.col("_end") >= F.col("_start"), F.sequence("_start", "_end"))
        spread = seen.select("n", "stock_code", F.col("t").alias("_t"), *own, F.explode(places).alias("t"))
        here = F.col("t") == F.col("_t")
        cells = spread.select("t", "n", "stock_code", *(F.when(here, F.col(c)).alias(c) for c in own))
        return cells.join(self.dates.select("t", "trade_date"), "t")

    def rows(self) -> DataFrame:
        """The dense grid."""
        return self._cells().select("t", "trade_date", "n", "stock_code", *MATRIX)

    def returns(self, kind: str = "simple", *, dense: bool = True) -> DataFrame:
        """t, trade_date, n, stock_code, ret against the session before; null on the first, or if either price is missing or unfit.

        'simple': p / p_before - 1; 'log': its logarithm.  A price of 0 before, and a ratio that has no logarithm, give null.  Computed over
        bars alone: the bar before counts only if it lies one session back.  ``dense`` adds the cells that have no bar.
        """
        if kind not in ("simple", "log"):
            raise ValueError(f"kind is 'simple' or 'log', not {kind!r}")
        by = Window.partitionBy("n", "stock_code").orderBy("t")
        before = F.when(F.lag("t").over(by) == F.col("t") - 1, F.lag("adj_close").over(by))
        ratio = F.try_divide(F.col("adj_close"), before)
        value = ratio - 1 if kind == "simple" else F.log(ratio)
        if dense:
            return self._cells(value).select("t", "trade_date", "n", "stock_code", "ret")
        return self._observed().where("t is not null").withColumn("ret", value).select("t", "trade_date", "n", "stock_code", "ret")

    def active_mask(self, asof: str) -> DataFrame:
        """n, stock_code, is_active: whether each code has a price on that date; all false if the date is not in the panel."""
        on = self.bars.where(F.col("trade_date") == F.lit(asof).cast("date")).where("adj_close is not null").select("stock_code", F.lit(True).alias("_on")).distinct()
        return self.stocks.join(on, "stock_code", "left").select("n", "stock_code", F.coalesce("_on", F.lit(False)).alias("is_active"))

    def tiles(self) -> DataFrame:
        """tile_t, tile_n, t, n, width, cells: the grid cut into tiles of at most ``TILE`` dates and codes from (t, n) on.

        cells: for each date in order, for each of the tile's ``width`` codes in order, an array of the six fields.  A tile is of bounded size,
        whatever the panel's.
        """
        spot = F.struct("t", "n", F.array(*MATRIX).alias("cell"))
        by = self.rows().groupBy(F.floor(F.col("t") / TILE[0]).alias("tile_t"), F.floor(F.col("n") / TILE[1]).alias("tile_n"))
        made = by.agg(F.transform(F.array_sort(F.collect_list(spot)), lambda x: x["cell"]).alias("cells"), F.min("t").alias("t"), F.min("n").alias("n"), (F.max("n") - F.min("n") + 1).alias("width"))
        return made.select("tile_t", "tile_n", "t", "n", "width", "cells")

    def matrix(self, first: int = 0, last: int | None = None) -> DataFrame:
        """t, trade_date, cells: for each date, or each from ``first`` to ``last``, an array of codes in order, each an array of the six
        fields; put together from tiles."""
        tiles = self.tiles().where(F.col("tile_t") >= first // TILE[0])
        tiles = tiles if last is None else tiles.where(F.col("tile_t") <= last // TILE[0])
        cut = F.expr("transform(sequence(0, cast(size(cells) div width as int) - 1), k -> struct(t + k as t, slice(cells, k * cast(width as int) + 1, cast(width as int)) as own))")
        rows = tiles.select("tile_n", F.inline(cut)).where(F.col("t") >= first)
        rows = rows if last is None else rows.where(F.col("t") <= last)
        joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("tile_n", "own"))), lambda x: x["own"]))
        return rows.groupBy("t").agg(joined.alias("cells")).join(self.dates.select("t", "trade_date"), "t").select("t", "trade_date", "cells")

    def wide(self, field: str, codes: Sequence[str]) -> DataFrame:
        """One row for each date, one column for each of ``codes``; null where there is no bar; an error where there are two."""
        once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a day and code occur more than once")).cast("double")).otherwise(F.first(field))
        return self.bars.groupBy("trade_date").pivot("stock_code", list(codes)).agg(once)
