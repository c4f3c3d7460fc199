"""Geography: states, cities, drill-down pages, votes by money."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import city_key


def by_place(receipts: DataFrame, keys: tuple[str, ...], amount: str = "amount", donor: str = "donor_key") -> DataFrame:
    return receipts.groupBy(*keys).agg(F.round(F.sum(amount), 2).alias("total_amount"), F.count("*").alias("n"), F.countDistinct(donor).alias("donor_count"))


def cities(receipts: DataFrame) -> DataFrame:
    return by_place(receipts.withColumn("city_key", city_key(F.col("city"), F.col("state"))), ("city_key",))


def page(df: DataFrame, order: list, size: int, number: int) -> DataFrame:
    """One page of a sorted table with row and page counts; a page beyond the last is the last. A limit is the feature here."""
    total = df.count()
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.withColumn("total_rows", F.lit(total).cast("long")).withColumn("total_pages", F.lit(pages).cast("long"))


def drilldown(receipts: DataFrame, state: str, size: int = 25, number: int = 1) -> DataFrame:
    """Donors of one state by money, paged, with the cell's total and the difference between rounded and unrounded sums."""
    own = receipts.where(F.col("state") == state)
    donors = own.groupBy("donor_key").agg(F.max("donor_name").alias("donor_name"), F.round(F.sum("amount"), 2).alias("total_amount"), F.count("*").alias("n"))
    head = own.agg(F.round(F.sum("amount"), 2).alias("cell_total"))
    return page(donors, [F.desc("total_amount"), "donor_key"], size, number).crossJoin(F.broadcast(head))


def region_vote(receipts: DataFrame, key: str = "committee_id", region: str = "region") -> DataFrame:
    """The region with most money per key, ties by name."""
    sums = receipts.groupBy(key, region).agg(F.round(F.sum("amount"), 2).alias("total_amount"))
    best = Window.partitionBy(key).orderBy(F.desc("total_amount"), region)
    return sums.withColumn("__n", F.row_number().over(best)).where("__n = 1").select(key, region, "total_amount")


def state_shares(receipts: DataFrame, valid: list[str]) -> DataFrame:
    """Shares of the full total per valid state; other rows count in the total only, as unknown."""
    known = F.when(F.col("state").isin(valid), F.col("state"))
    sums = receipts.groupBy(known.alias("state")).agg(F.round(F.sum("amount"), 2).alias("total_amount"))
    everything = Window.partitionBy(F.lit(0))
    return sums.withColumn("share", F.round(F.col("total_amount") / F.sum("total_amount").over(everything), 4)).withColumn("state", F.coalesce("state", F.lit("unknown")))
