"""Sinks and load guards: files, partitioned tables, row-count guards, fingerprints, column census, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True, quoteAll=False, escape='"')


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Parquet, partitioned by columns of few values; dynamic overwrite replaces only the partitions written."""
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).parquet(path)


class LoadRefused(ValueError):
    pass


def guard_row_count(df: DataFrame, last: int | None, least_share: float = 0.9) -> int:
    """Row count of df; refuses a load that fell below the share of the last success."""
    n = df.count()
    if last and n < last * least_share:
        raise LoadRefused(f"{n} rows, {last} at the last load")
    return n


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """(rows, order-free hash sum): equal inputs give equal fingerprints, so an unchanged job can be skipped."""
    row = df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("h")).first()
    return row["n"], row["h"]


def census(df: DataFrame) -> DataFrame:
    """(column, kind, filled, fill_rate, distinct_about, example) of every column, from one pass."""
    parts = []
    for c, kind in df.dtypes:
        col = F.col(f"`{c}`")
        filled = col.isNotNull() & (F.trim(col) != "") if kind == "string" else col.isNotNull()
        parts.append(
            F.struct(
                F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.count(F.when(filled, 1)).alias("filled"), F.round(F.count(F.when(filled, 1)) / F.count("*"), 4).alias("fill_rate"),
                F.approx_count_distinct(col).alias("distinct_about"), F.min(col.cast("string")).alias("example"),
            )
        )
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of added, removed, changed and same rows between two snapshots."""
    values = [c for c in before.columns if c not in keys]
    a = before.select(*keys, F.xxhash64(*values).alias("__a"))
    b = after.select(*keys, F.xxhash64(*values).alias("__b"))
    both = a.join(b, keys, "full")
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__a") != F.col("__b"), "changed").otherwise("same")
    return both.groupBy(change.alias("change")).agg(F.count("*").alias("n"))


def freshness(df: DataFrame, day: str, today: str, stale_after: int) -> DataFrame:
    """Latest day, age in days and whether it is stale."""
    age = F.date_diff(F.lit(today).cast("date"), F.max(day))
    return df.agg(F.max(day).alias("latest"), age.alias("age_days"), (age > stale_after).alias("stale"))


def table_available(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)
