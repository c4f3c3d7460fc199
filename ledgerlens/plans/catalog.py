"""Registration of queries with their DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.sources.civic import STORED, VIEWS, civic, stored, table, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables and civic views of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in STORED:
            return stored(self.spark, self.sf_dir, name)
        return civic(self.spark, self.sf_dir, name) if name in VIEWS else table(self.spark, self.sf_dir, name)


def query(name: str, oracle: str | None = None):
    """Register a function of Tables as a query."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = with_views(oracle)
        return f

    return add


def sql_query(name: str, sql: str, oracle: str | None = None) -> None:
    """Register one SQL text over tables and civic views; without an oracle the same text runs on DuckDB."""
    import re

    known = [*VIEWS, *"region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = Tables(spark, sf_dir)
        used = {n for n in known if re.search(rf"\b{n}\b", sql)}
        text = re.sub(r"\b(FROM|JOIN)\s+(\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], sql)
        return spark.sql(text, **{n: getattr(tables, n) for n in used if f"{{{n}}}" in text})

    QUERIES[name] = run
    ORACLES[name] = with_views(oracle or sql)
