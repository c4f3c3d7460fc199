"""Time series: moving averages, month over month, running sums, bands by year, growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.predicates import cycle
from ledgerlens.functions.text import size_band


def time_series(months: DataFrame, keep: int = 24) -> DataFrame:
    """The last `keep` months present, with a moving average of up to three rows and the change from the row before.

    Ranks run over monthly totals (one row per month), never over receipts.
    """
    last = Window.partitionBy(F.lit(0)).orderBy(F.desc("month"))
    rows = months.withColumn("__n", F.row_number().over(last)).where(F.col("__n") <= keep)
    order = Window.partitionBy(F.lit(0)).orderBy("month")
    previous = F.lag("total_amount").over(order)
    return rows.select(
        "month", "total_amount", "contribution_count", F.round(F.avg("total_amount").over(order.rowsBetween(-2, 0)), 2).alias("ma3"),
        F.when(previous != 0, F.round((F.col("total_amount") - previous) / previous * 100, 2)).alias("mom_pct"),
    )


def cumulative(months: DataFrame, key: str) -> DataFrame:
    """Running sum by month within a key."""
    upto = Window.partitionBy(key).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return months.withColumn("running_total", F.round(F.sum("total_amount").over(upto), 2))


def top_keys(df: DataFrame, key: str, amount: str, n: int) -> DataFrame:
    """Keys with the n largest sums; a top-k report."""
    return df.groupBy(key).agg(F.round(F.sum(amount), 2).alias("key_total")).orderBy(F.desc("key_total"), key).limit(n)


def size_bands_by_year(receipts: DataFrame, amount: str = "amount", day: str = "received_date") -> DataFrame:
    rows = receipts.where(F.col(day).isNotNull()).groupBy(F.year(day).cast("int").alias("year"), size_band(F.col(amount)).alias("band"))
    return rows.agg(F.round(F.sum(amount), 2).alias("total_amount"), F.count("*").alias("n"))


def growth(spending: DataFrame, key: str, year_a: int, year_b: int, amount: str = "amount", day: str = "expended_date") -> DataFrame:
    """Two years side by side for keys with money in both, and the ratio; one pass."""
    year = F.year(day)
    sums = spending.where(year.isin(year_a, year_b)).groupBy(key).agg(
        F.round(F.sum(F.when(year == year_a, F.col(amount))), 2).alias("before"), F.round(F.sum(F.when(year == year_b, F.col(amount))), 2).alias("after")
    )
    return sums.where((F.col("before") > 0) & (F.col("after") > 0)).withColumn("ratio", F.round(F.col("after") / F.col("before"), 4))


def cycle_totals(receipts: DataFrame, keys: tuple[str, ...], amount: str = "amount", day: str = "received_date") -> DataFrame:
    """Totals per cycle; rows without a date keep a null cycle of their own."""
    return receipts.groupBy(*keys, cycle(F.col(day)).alias("cycle")).agg(F.round(F.sum(amount), 2).alias("total_amount"), F.count("*").alias("n"))
