"""Rollups: donor-committee, donor, donor-cycle, monthly, large contributions, payees and recipients."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.names import name_max, name_mode
from ledgerlens.functions.predicates import cycle, month_key


def money(c: str | Column) -> Column:
    return F.round(F.sum(c), 2)


def donor_committee(receipts: DataFrame, donor: str = "donor_key", committee: str = "committee_id", amount: str = "amount", day: str = "received_date", name: str = "donor_name") -> DataFrame:
    """One row per (donor, committee): total, count, first and last date. Blank donor keys are left out."""
    rows = receipts.where(F.coalesce(F.trim(donor), F.lit("")) != "")
    return rows.groupBy(donor, committee).agg(
        name_max(name).alias("donor_name"), money(amount).alias("total_amount"), F.count("*").alias("contribution_count"), F.min(day).alias("first_date"), F.max(day).alias("last_date")
    )


def donor_summary(edges: DataFrame, donor: str = "donor_key", committee: str = "committee_id") -> DataFrame:
    """One row per donor from donor-committee rows."""
    return edges.groupBy(donor).agg(
        name_max("donor_name").alias("donor_name"), money("total_amount").alias("total_amount"), F.sum("contribution_count").alias("contribution_count"),
        F.count(committee).alias("committee_count"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"),
    )


def donor_cycle_summary(receipts: DataFrame, donor: str = "donor_key", committee: str = "committee_id", amount: str = "amount", day: str = "received_date", name: str = "donor_name") -> DataFrame:
    """One row per (cycle, donor); rows without a date or a donor key are left out."""
    rows = receipts.where(F.col(day).isNotNull() & (F.coalesce(F.trim(donor), F.lit("")) != ""))
    return rows.groupBy(cycle(F.col(day)).alias("cycle"), donor).agg(
        name_max(name).alias("donor_name"), money(amount).alias("total_amount"), F.count("*").alias("contribution_count"), F.countDistinct(committee).alias("committee_count")
    )


def monthly_totals(receipts: DataFrame, keys: tuple[str, ...] = (), amount: str = "amount", day: str = "received_date") -> DataFrame:
    """One row per month (and keys); rows without a date are left out."""
    rows = receipts.where(F.col(day).isNotNull())
    return rows.groupBy(*keys, month_key(F.col(day)).alias("month")).agg(money(amount).alias("total_amount"), F.count("*").alias("contribution_count"))


def _value_ranks(df: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, value, __below, __upto, __all): how many rows lie below and up to each distinct value of its key.

    Values are counted first; ranks run inside bands (an eighth of a doubling, by sign) and the counts of the bands before give the offsets, so that no
    task holds all values of a key, nor of the whole table.
    """
    x = F.col(value)
    band = F.when(x == 0, F.lit(0)).otherwise(F.signum(x) * (F.floor(F.log2(F.abs(x)) * 8) + 4_096)).cast("long")
    counts = df.where(x.isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n")).withColumn("__band", band)
    inside = Window.partitionBy(*keys, "__band").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    bands = counts.groupBy(*keys, "__band").agg(F.sum("__n").alias("__m"))
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    bands = bands.withColumn("__before", F.sum("__m").over(own.orderBy("__band").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__m")).withColumn("__all", F.sum("__m").over(own))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = counts.withColumn("__run", F.sum("__n").over(inside)).alias("c").join(bands.alias("b"), reduce(lambda p, q: p & q, [F.col("c.__band") == F.col("b.__band"), *same]))
    upto = F.col("__before") + F.col("__run")
    return joined.select(*[F.col(f"c.{k}").alias(k) for k in keys], F.col(f"c.{value}").alias(value), (upto - F.col("__n")).alias("__below"), upto.alias("__upto"), "__all")


def floor_rank(df: DataFrame, value: str, p: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Value at the ascending rank floor((n - 1) * p) + 1, and n."""
    rank = F.floor((F.col("__all") - 1) * F.lit(p)) + 1
    return _value_ranks(df, value, keys).where((F.col("__below") < rank) & (rank <= F.col("__upto"))).select(*keys, F.col(value).alias("value"), F.col("__all").alias("n"))


def floor_ranks(df: DataFrame, value: str, marks: dict[str, float]) -> DataFrame:
    """(marker, value) for several percentiles in one pass."""
    rows = _value_ranks(df, value, ()).withColumn("__m", F.explode(F.array(*[F.struct(F.lit(n).alias("marker"), F.lit(p).alias("p")) for n, p in marks.items()])))
    rank = F.floor((F.col("__all") - 1) * F.col("__m.p")) + 1
    return rows.where((F.col("__below") < rank) & (rank <= F.col("__upto"))).select("__m.marker", F.col(value).alias("value"))


def interpolated(df: DataFrame, value: str, p: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Interpolated percentile (percentile_cont), from the two values around its rank."""
    place = (F.col("__all") - 1) * F.lit(p)
    near = _value_ranks(df, value, keys).where((F.col("__below") <= F.ceil(place)) & (F.floor(place) < F.col("__upto")))
    low = F.max(F.when((F.col("__below") <= F.floor(place)) & (F.floor(place) < F.col("__upto")), F.col(value)))
    high = F.max(F.when((F.col("__below") <= F.ceil(place)) & (F.ceil(place) < F.col("__upto")), F.col(value)))
    out = near.groupBy(*keys).agg(low.alias("__low"), high.alias("__high"), F.max("__all").alias("n"))
    share = (F.col("n") - 1) * F.lit(p) - F.floor((F.col("n") - 1) * F.lit(p))
    return out.select(*keys, (F.col("__low") + (F.col("__high") - F.col("__low")) * share).alias("value"), "n")


def large_contributions(receipts: DataFrame, amount: str = "amount", least: float = 5000.0, factor: float = 2.0, p: float = 0.95) -> DataFrame:
    """Receipts at or above max(least, factor x the floor-rank percentile), with the threshold; the percentile is one row."""
    limit = floor_rank(receipts, amount, p).select(F.greatest(F.lit(least), F.col("value") * factor).alias("threshold"))
    return receipts.crossJoin(F.broadcast(limit)).where(F.col(amount) >= F.col("threshold"))


def payee_rollup(spending: DataFrame, keys: tuple[str, ...] = ("committee_id",), payee: str = "payee_name", amount: str = "amount", day: str = "expended_date") -> DataFrame:
    """Payees by normalized name with the commonest spelling."""
    rows = spending.withColumn("payee_key", F.lower(F.trim(payee))).where("payee_key <> ''")
    return rows.groupBy(*keys, "payee_key").agg(name_mode(payee).alias("payee_name"), money(amount).alias("total_amount"), F.count("*").alias("payment_count"), F.min(day).alias("first_date"), F.max(day).alias("last_date"))


def recipient_summary(spending: DataFrame, payee: str = "payee_name", committee: str = "committee_id", amount: str = "amount") -> DataFrame:
    rows = spending.withColumn("recipient_key", F.lower(F.trim(payee))).where("recipient_key <> ''")
    return rows.groupBy("recipient_key").agg(name_mode(payee).alias("recipient_name"), money(amount).alias("total_amount"), F.count("*").alias("payment_count"), F.countDistinct(committee).alias("committee_count"))


def part_sums(rows: DataFrame, keys: tuple[str, ...], parts: tuple[str, ...], part: str = "d2_part", amount: str = "amount") -> DataFrame:
    """Sums by the first character of the part code, in one pass."""
    code = F.coalesce(F.substring(part, 1, 1), F.lit(""))
    sums = [F.round(F.coalesce(F.sum(F.when(code == p, F.col(amount))), F.lit(0.0)), 2).alias(f"part_{p}_sum") for p in parts]
    other = F.round(F.coalesce(F.sum(F.when(~code.isin(*parts), F.col(amount))), F.lit(0.0)), 2).alias("other_sum")
    return rows.groupBy(*keys).agg(*sums, other, F.count("*").alias("row_count"))
