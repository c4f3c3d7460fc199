"""Organizations of the federal register: latest registration, ledgers, rollups, statistics and their graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(orgs: DataFrame, order: list[Column]) -> DataFrame:
    """One registration per filer number, the first in the order."""
    return orgs.withColumn("__n", F.row_number().over(Window.partitionBy("ein").orderBy(*order))).where("__n = 1").drop("__n")


def ledger(rows: DataFrame, name: str, amount: str = "amount", day: str = "paid_on") -> DataFrame:
    """Sums per filer and name as written: two spellings stay two lines."""
    return rows.groupBy("ein", name).agg(F.count("*").alias("n"), F.round(F.sum(amount), 2).alias("total_amount"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def rollup(rows: DataFrame, home: str = "IL", amount: str = "amount", day: str = "paid_on") -> DataFrame:
    """Per filer and year: payments, recipients, money, and money in the home state."""
    at_home = F.round(F.coalesce(F.sum(F.when(F.col("state") == home, F.col(amount))), F.lit(0.0)), 2)
    return rows.groupBy("ein", F.year(day).alias("year")).agg(F.count("*").alias("n"), F.countDistinct("recipient_name").alias("recipients"), F.round(F.sum(amount), 2).alias("total_amount"), at_home.alias("home_amount"))


def dark_money(rows: DataFrame, home: str = "IL", amount: str = "amount") -> DataFrame:
    """One row: how much organizations spent in the home state, and the share of the largest."""
    own = rows.where(F.col("state") == home).groupBy("ein").agg(F.round(F.sum(amount), 2).alias("t"), F.count("*").alias("n"))
    return own.agg(F.count("*").alias("organizations"), F.sum("n").alias("payments"), F.round(F.sum("t"), 2).alias("total_amount"), F.max("t").alias("largest"), F.round(F.max("t") / F.sum("t"), 6).alias("largest_share"))


def graph(spending: DataFrame, committees: DataFrame, directors: DataFrame, cap: int) -> DataFrame:
    """(edge_type, src, dst, weight): payments, committees of like names and donors who are directors; the `cap` heaviest edges of each type."""
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    edges = spending.groupBy(F.lit("payment").alias("edge_type"), node("org", "ein").alias("src"), node("payee", "recipient_name").alias("dst")).agg(F.round(F.sum("amount"), 2).alias("weight"))
    edges = edges.unionByName(committees.groupBy(F.lit("name_match").alias("edge_type"), node("org", "ein").alias("src"), node("committee", "committee_id").alias("dst")).agg(F.max("score").alias("weight")))
    edges = edges.unionByName(directors.groupBy(F.lit("director").alias("edge_type"), node("donor", "donor_key").alias("src"), node("org", "ein").alias("dst")).agg(F.max("score").alias("weight")))
    rank = F.row_number().over(Window.partitionBy("edge_type").orderBy(F.desc("weight"), "src", "dst"))
    return edges.withColumn("__n", rank).where(F.col("__n") <= cap).drop("__n")
