"""Races: linked money, outside spending, pressure, top payees, competition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import name_key, people


def race_builder(candidates: DataFrame, links: DataFrame, committee_totals: DataFrame, outside: DataFrame) -> DataFrame:
    """One row per race: candidates, money, outside spending, pressure (outside / money), top candidate share.

    A committee's total (one row per committee and link) counts once, as its maximum, and is split evenly over its linked candidates.
    """
    once = links.join(committee_totals, "committee_id").groupBy("committee_id", "candidate_id").agg(F.sum("total_amount").alias("s"))
    once = once.withColumn("m", F.max("s").over(Window.partitionBy("committee_id"))).withColumn("n", F.count("*").over(Window.partitionBy("committee_id")))
    money = once.groupBy("candidate_id").agg(F.sum(F.col("m") / F.col("n")).alias("money"))
    spent = outside.groupBy("candidate_id").agg(F.sum("amount").alias("outside"))
    rows = candidates.join(money, "candidate_id", "left").join(spent, "candidate_id", "left").na.fill(0.0, ["money", "outside"])
    out = rows.groupBy("race_key").agg(
        F.count("*").alias("candidate_count"), F.round(F.sum("money"), 2).alias("money"), F.round(F.sum("outside"), 2).alias("outside"),
        F.round(F.max("money") / F.sum("money"), 4).alias("top_candidate_share"), F.round(F.sum("outside") / F.sum("money"), 4).alias("pressure"),
    )
    return out


def outside_by_candidate(spending: DataFrame) -> DataFrame:
    """Support and oppose sums per candidate; rows with neither flag are left out."""
    rows = spending.where(F.col("d2_part").like("9%") & (F.col("supporting") | F.col("opposing")))
    return rows.groupBy("candidate_id").agg(
        F.round(F.coalesce(F.sum(F.when(F.col("supporting"), F.col("amount"))), F.lit(0.0)), 2).alias("support"), F.round(F.coalesce(F.sum(F.when(F.col("opposing"), F.col("amount"))), F.lit(0.0)), 2).alias("oppose"),
        F.countDistinct("committee_id").alias("spenders"),
    )


def attribute_named(rows: DataFrame, names: str, amount: str, candidates: DataFrame, candidate_name: str = "candidate_name", row_id: str = "row_id") -> DataFrame:
    """Shares of rows that name n people: amount / n each, n counting named people that no candidate matches; once per candidate and row."""
    named = rows.withColumn("__people", people(F.col(names))).withColumn("__n", F.size("__people")).where("__n > 0")
    shares = named.select(row_id, (F.col(amount) / F.col("__n")).alias("share"), "__n", F.explode("__people").alias("person"))
    keyed = shares.withColumn("__key", name_key(F.col("person")))
    own = candidates.withColumn("__key", name_key(F.col(candidate_name))).where("__key IS NOT NULL")
    found = keyed.join(own, "__key").dropDuplicates([row_id, "candidate_id"])
    return found.select(row_id, "candidate_id", F.round("share", 2).alias("share"), F.col("__n").alias("named"))


def top_per_group(df: DataFrame, group: str, item: str, amount: str, n: int) -> DataFrame:
    """The n largest items of each group."""
    sums = df.groupBy(group, item).agg(F.round(F.sum(amount), 2).alias("total_amount"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("total_amount"), item))
    return sums.withColumn("rank", rank).where(F.col("rank") <= n)


def fold_other(df: DataFrame, key: str, amount: str, n: int) -> DataFrame:
    """The n largest keys by total (ties by key), the rest as one `other`; the sum does not change."""
    totals = df.groupBy(key).agg(F.round(F.sum(amount), 2).alias("total_amount"))
    top = totals.orderBy(F.desc("total_amount"), key).limit(n)  # a partial top-n, not a ranking of all keys
    rest = totals.join(F.broadcast(top.select(F.col(key).alias("__k"))), F.col(key).eqNullSafe(F.col("__k")), "left_anti").agg(F.round(F.sum("total_amount"), 2).alias("total_amount"))
    return top.select(F.col(key).cast("string").alias("node"), "total_amount").unionByName(rest.where("total_amount IS NOT NULL").select(F.lit("other").alias("node"), "total_amount"))
