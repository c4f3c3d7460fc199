"""Representative names of a group: four rules that give different answers, and a top variant by money."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def name_max(c: str) -> Column:
    return F.max(c)


def name_min(c: str) -> Column:
    return F.min(c)


def name_mode(c: str) -> Column:
    """Commonest value, the smallest of those tied."""
    return F.expr(f"mode() WITHIN GROUP (ORDER BY {c})")


def top_variant(df: DataFrame, key: str, name: str, amount: str) -> DataFrame:
    """(key, name) with the variant of the largest sum, the smallest name if tied."""
    sums = df.groupBy(key, name).agg(F.round(F.sum(amount), 2).alias("__sum"))
    order = Window.partitionBy(key).orderBy(F.desc("__sum"), F.col(name))
    return sums.withColumn("__n", F.row_number().over(order)).where("__n = 1").select(key, name)
