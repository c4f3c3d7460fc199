"""Filings: choosing the live version, condensation, reconciliation, committee money."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pick_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in the order (distinct on)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def live_filings(filings: DataFrame, admin: tuple[str, ...] = ()) -> DataFrame:
    """Per filer and period the live filing: one with totals before one without, latest received, largest id; nulls last."""
    rows = filings.where(~F.coalesce(F.col("doc_type").isin(list(admin)), F.lit(False))) if admin else filings
    return pick_first(rows, ["committee_id", "period_end"], [F.col("d2_id").isNotNull().desc(), F.col("received_on").desc_nulls_last(), F.desc("filing_id")])


def most_recent_filing(filings: DataFrame, admin: tuple[str, ...] = ()) -> DataFrame:
    """Per filer the filing of the latest period, then latest received, then largest id."""
    rows = filings.where(~F.coalesce(F.col("doc_type").isin(list(admin)), F.lit(False))) if admin else filings
    return pick_first(rows, ["committee_id"], [F.col("period_end").desc_nulls_last(), F.col("d2_id").isNotNull().desc(), F.col("received_on").desc_nulls_last(), F.desc("filing_id")])


def condense(rows: DataFrame, latest: DataFrame, picked: DataFrame, day: str, keep_unfiled: bool) -> DataFrame:
    """Rows after the latest filing's period, united (as a set) with the rows of picked filings.

    keep_unfiled: rows of filers without any filing stay (receipts); otherwise they go (expenditures).
    """
    ends = latest.select("committee_id", F.col("period_end").alias("__end"))
    later = rows.join(ends, "committee_id", "left" if keep_unfiled else "inner")
    later = later.where(F.col("__end").isNull() | (F.col(day) > F.col("__end"))).drop("__end") if keep_unfiled else later.where(F.col(day) > F.col("__end")).drop("__end")
    chosen = rows.join(picked.select("filing_id").distinct(), "filing_id", "left_semi")
    return later.unionByName(chosen).distinct()


def reconcile(filings: DataFrame, receipts: DataFrame, total: str = "total_receipts", day: str = "received_date", keep: tuple[str, ...] = ("committee_id",)) -> DataFrame:
    """Per filing: itemized rows, their sum and dates, and the difference from the reported total (rows before the join are sums)."""
    items = receipts.groupBy("filing_id").agg(F.count("*").alias("row_count"), F.sum("amount").alias("__sum"), F.min(day).alias("first_date"), F.max(day).alias("last_date"))
    found = filings.select("filing_id", *keep, F.col(total).alias("reported")).join(items, "filing_id", "left")
    itemized = F.round(F.coalesce("__sum", F.lit(0.0)), 2)
    return found.select(
        "filing_id", *keep, "reported", F.coalesce("row_count", F.lit(0)).alias("row_count"), itemized.alias("itemized"), "first_date", "last_date", F.round(itemized - F.col("reported"), 2).alias("difference")
    )


def mismatch_status(recon: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Four statuses with a relative tolerance, and the ratio itemized / reported."""
    reported, itemized = F.col("reported"), F.col("itemized")
    status = (
        F.when((F.coalesce(reported, F.lit(0.0)) == 0) & (itemized == 0), "empty").when(itemized == 0, "no_itemized").when(F.coalesce(reported, F.lit(0.0)) == 0, "no_reported")
        .when(F.abs(itemized - reported) <= tolerance * reported, "match").otherwise("mismatch")
    )
    return recon.withColumn("status", status).withColumn("ratio", F.when(reported > 0, F.round(itemized / reported, 4)))


def recon_outliers(recon: DataFrame, floor: float = 1000.0, n: int = 50) -> DataFrame:
    return recon.where(F.abs("difference") >= floor).orderBy(F.abs("difference").desc(), "filing_id").limit(n)


def committee_money(latest: DataFrame, receipts: DataFrame, committees: DataFrame, funds: str = "funds") -> DataFrame:
    """Reported funds plus receipts after the latest filing's period."""
    ends = latest.select("committee_id", F.col("period_end").alias("__end"))
    later = receipts.join(ends, "committee_id", "left").where(F.col("__end").isNull() | (F.col("received_date") > F.col("__end")))
    sums = later.groupBy("committee_id").agg(F.sum("amount").alias("__sum"))
    return committees.join(sums, "committee_id", "left").select("committee_id", F.round(F.col(funds) + F.coalesce("__sum", F.lit(0.0)), 2).alias("money"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows by key, the largest version wins; on equal versions the new row does."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return pick_first(both, keys, [F.col(version).desc_nulls_last(), F.desc("__new")]).drop("__new")


def finance_by_cycle(filings: DataFrame) -> DataFrame:
    """Per filer and cycle of the period: filings, live filings, sums and archived count; a missing period is a group of its own."""
    cycle = (F.year("period_end") + F.pmod(F.year("period_end"), F.lit(2))).cast("int")
    live = ~F.coalesce("archived", F.lit(False))
    return filings.groupBy("committee_id", cycle.alias("cycle")).agg(
        F.countDistinct(F.when(live, F.col("filing_id"))).alias("filing_count"), F.round(F.coalesce(F.sum(F.when(live, F.col("total_receipts"))), F.lit(0.0)), 2).alias("sum_receipts"),
        F.max(F.when(live, F.col("total_receipts"))).alias("max_receipts"), F.sum(F.when(live, 0).otherwise(1)).alias("archived_count"),
    )
