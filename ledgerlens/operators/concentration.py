"""Concentration: HHI, Gini, shares of the largest, donor provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def concentration(edges: DataFrame, group: str = "committee_id", member: str = "donor_key", amount: str = "total_amount", tops: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per group over members with a positive sum: total, members, HHI (0 to 10,000), Gini, top shares.

    A group may hold a third of all members, so no task ranks a whole group: equal amounts are counted first, ranks run inside bands of
    amounts (an eighth of a doubling each), and the counts of the bands below give the offsets. The largest members come from a limit that
    applies before the exchange.
    """
    rows = edges.where(F.col(amount) > 0).select(group, F.col(amount).alias("__x"))
    values = rows.groupBy(group, "__x").agg(F.count("*").alias("__c")).withColumn("__band", F.floor(F.log2("__x") * 8))
    below = Window.partitionBy(group).orderBy("__band").rowsBetween(Window.unboundedPreceding, 0)
    bands = values.groupBy(group, "__band").agg(F.sum("__c").alias("__n")).withColumn("__below", F.sum("__n").over(below) - F.col("__n")).drop("__n")
    inside = Window.partitionBy(group, "__band").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("__upto", F.sum("__c").over(inside)).join(bands, [group, "__band"])
    before = F.col("__below") + F.col("__upto") - F.col("__c")
    sums = ranked.groupBy(group).agg(
        F.sum(F.col("__x") * F.col("__c")).alias("__total"), F.sum("__c").alias("donor_count"), F.sum(F.col("__x") * F.col("__x") * F.col("__c")).alias("__squares"),
        F.sum(F.col("__x") * (F.col("__c") * before + F.col("__c") * (F.col("__c") + 1) / 2)).alias("__ranks"),
    )
    down = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("__x")))
    largest = rows.withColumn("__down", down).where(F.col("__down") <= max(tops)).groupBy(group).agg(*[F.sum(F.when(F.col("__down") <= k, F.col("__x"))).alias(f"__top{k}") for k in tops])
    n, total = F.col("donor_count"), F.col("__total")
    return sums.join(largest, group).select(
        group, F.round(total, 2).alias("total_amount"), "donor_count", F.round(F.col("__squares") / (total * total) * 10000, 2).alias("hhi"),
        F.round(2 * F.col("__ranks") / (n * total) - (n + 1) / n, 4).alias("gini"), *[F.round(F.col(f"__top{k}") / total, 4).alias(f"top{k}_share") for k in tops],
    )


def provenance(edges: DataFrame, n: int = 5, group: str = "committee_id", member: str = "donor_key", name: str = "donor_name", amount: str = "total_amount") -> DataFrame:
    """The n largest members of each group with rank, share of the group's total, and what the n leave unattributed.

    Totals are sums and ranks stop at n, so both shrink before the exchange.
    """
    own = Window.partitionBy(group)
    rows = edges.where(F.col(amount) > 0)
    totals = rows.groupBy(group).agg(F.round(F.sum(amount), 2).alias("group_total"))
    top = rows.select(group, member, name, amount).withColumn("rank", F.row_number().over(own.orderBy(F.desc(amount), name, member))).where(F.col("rank") <= n)
    left = F.round(F.col("group_total") - F.sum(amount).over(own), 2)
    found = top.join(totals, group).withColumn("share", F.round(F.col(amount) / F.col("group_total"), 4)).withColumn("unattributed", left)
    return found.select(group, "rank", member, name, amount, "share", "group_total", "unattributed")


def hhi_over(df: DataFrame, group: str, part: str, amount: str) -> DataFrame:
    """HHI of a group's money over any part (states of a race, for example)."""
    sums = df.groupBy(group, part).agg(F.sum(amount).alias("__s")).where("__s > 0")
    own = Window.partitionBy(group)
    shares = sums.withColumn("__share", F.col("__s") / F.sum("__s").over(own))
    return shares.groupBy(group).agg(F.round(F.sum(F.col("__share") ** 2) * 10000, 2).alias("hhi"), F.count("*").alias("parts"), F.round(F.max("__share"), 4).alias("top_share"))
