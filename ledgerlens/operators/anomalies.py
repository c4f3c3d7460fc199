"""Anomaly rules: large single receipts, monthly spikes (two definitions), high concentration, and their union."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.concentration import concentration
from ledgerlens.operators.rollups import donor_committee, large_contributions, monthly_totals


def spikes_present(receipts: DataFrame, key: str = "committee_id", ratio: float = 3.0, delta: float = 2000.0, min_months: int = 4, covered: DataFrame | None = None) -> DataFrame:
    """Months at least `ratio` times and `delta` above the mean of exactly the three prior months present in the data.

    Keys with fewer than min_months months have none. `covered` (key, covered_through) limits the months tested to those that the latest
    quarterly covers.
    """
    months = monthly_totals(receipts, (key,))
    own = Window.partitionBy(key)
    before = own.orderBy("month").rowsBetween(-3, -1)
    rows = months.withColumn("__months", F.count("*").over(own)).withColumn("__prior", F.count("*").over(before)).withColumn("baseline", F.avg("total_amount").over(before))
    found = rows.where((F.col("__months") >= min_months) & (F.col("__prior") == 3) & (F.col("baseline") > 0))
    found = found.where((F.col("total_amount") >= ratio * F.col("baseline")) & (F.col("total_amount") - F.col("baseline") >= delta))
    if covered is not None:
        found = found.join(covered, key).where(F.last_day(F.to_date(F.concat("month", F.lit("-01")))) <= F.col("covered_through"))
    return found.select(key, "month", "total_amount", F.round("baseline", 2).alias("baseline"), F.round(F.col("total_amount") / F.col("baseline"), 2).alias("ratio"))


def zero_filled_months(months: DataFrame, key: str) -> DataFrame:
    """Every month between a key's first and last, missing ones with zero."""
    start = F.to_date(F.concat(F.col("month"), F.lit("-01")))
    ends = months.groupBy(key).agg(F.min(start).alias("a"), F.max(start).alias("b"))
    spine = ends.select(key, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("day")).select(key, F.date_format("day", "yyyy-MM").alias("month"))
    return spine.join(months, [key, "month"], "left").select(key, "month", F.coalesce("total_amount", F.lit(0.0)).alias("total_amount"), F.coalesce("contribution_count", F.lit(0)).alias("contribution_count"))


def spikes_zero_filled(receipts: DataFrame, key: str = "committee_id", ratio: float = 3.0, delta: float = 2000.0) -> DataFrame:
    """Months of the zero-filled calendar against the mean of the one to three prior months, compared after rounding to cents."""
    months = zero_filled_months(monthly_totals(receipts, (key,)), key)
    before = Window.partitionBy(key).orderBy("month").rowsBetween(-3, -1)
    rows = months.withColumn("baseline", F.round(F.avg("total_amount").over(before), 2))
    test = (F.col("baseline") > 0) & (F.round(F.col("total_amount") / F.col("baseline"), 2) >= ratio) & (F.round(F.col("total_amount") - F.col("baseline"), 2) >= delta)
    return rows.where(test).select(key, "month", "total_amount", "baseline", F.round(F.col("total_amount") / F.col("baseline"), 2).alias("ratio"))


def concentration_flags(receipts: DataFrame, hhi: float = 4500.0, min_donors: int = 3) -> DataFrame:
    found = concentration(donor_committee(receipts)).where((F.col("hhi") >= hhi) & (F.col("donor_count") >= min_donors))
    return found.select("committee_id", "hhi", "donor_count", F.round(F.col("hhi") / 2500, 2).alias("severity"))


def anomaly_union(receipts: DataFrame, hhi: float = 4500.0, min_donors: int = 3) -> DataFrame:
    """One row per flag of any rule, with a severity and an explanation."""
    large = large_contributions(receipts).select(
        F.lit("large_single").alias("rule"), "committee_id", F.date_format("received_date", "yyyy-MM").alias("month"), F.col("amount").alias("observed"),
        F.col("threshold").alias("baseline"), F.round(F.col("amount") / F.col("threshold"), 2).alias("severity"),
    )
    spike = spikes_present(receipts).select(F.lit("monthly_spike").alias("rule"), "committee_id", "month", F.col("total_amount").alias("observed"), "baseline", F.col("ratio").alias("severity"))
    flags = concentration_flags(receipts, hhi, min_donors)
    dense = flags.select(F.lit("high_concentration").alias("rule"), "committee_id", F.lit(None).cast("string").alias("month"), F.col("hhi").alias("observed"), F.lit(2500.0).alias("baseline"), "severity")
    return large.unionByName(spike).unionByName(dense)
