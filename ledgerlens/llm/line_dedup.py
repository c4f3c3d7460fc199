"""Cross-site boilerplate lines: HyperLogLog spread per line, exact counts near the threshold (DataFrames only).

Every line gets a sketch of the sites that it occurs on; sketches merge in partial aggregation. Lines whose estimate is far above the
threshold are boilerplate, those far below are not, and only the lines between get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import fresh, load, materialize

#: Registers of a sketch as a power of two (relative error about 3 %), and the margin that counts as near the threshold.
REGISTERS, MARGIN = 10, 0.2


def _hashes(column: str):
    return F.xxhash64(F.col(column)), F.xxhash64(F.lit(1), F.col(column))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """lines (l1, l2, site) -> (l1, l2) of the lines that occur on min_sites different sites or more."""
    low, high = min_sites * (1 - MARGIN) - 1, min_sites * (1 + MARGIN) + 1
    sketches = lines.groupBy("l1", "l2").agg(F.hll_sketch_agg("site", F.lit(REGISTERS)).alias("sketch"))
    spread = materialize(sketches.select("l1", "l2", F.hll_sketch_estimate("sketch").alias("n")).where(F.col("n") >= low), "spread")
    sure = spread.where(F.col("n") > high).select("l1", "l2")
    near = spread.where(F.col("n") <= high).select("l1", "l2")
    exact = lines.join(near, ["l1", "l2"], "left_semi").select("l1", "l2", "site").distinct().groupBy("l1", "l2").agg(F.count("*").alias("n"))
    return sure.unionByName(exact.where(F.col("n") >= min_sites).select("l1", "l2"))


def dedup_lines(df: DataFrame, text: str = "text", site: str = "source", min_sites: int = 8) -> DataFrame:
    """df with the text less its boilerplate lines, `n_lines` and `n_removed` (int).

    Lines end at line feeds; a line is boilerplate if it occurs on min_sites different sites, lines being told apart by a hash of 128 bits. Empty lines never
    are. A null site is a site of its own. Null texts stay null with no lines; a text may end up empty; no row is dropped and
    repeated rows stay. Clashing columns are replaced; an empty df gives an empty result.
    """
    df = fresh(df, "n_lines", "n_removed")
    names = df.columns
    where = F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("n"))
    h1, h2 = _hashes(text)
    split = df.where(F.col(text).isNotNull()).select(h1.alias("__t1"), h2.alias("__t2"), where.alias("site"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    l1, l2 = _hashes("line")
    lines = materialize(split.where("line <> ''").select("__t1", "__t2", "site", "pos", l1.alias("l1"), l2.alias("l2")), "lines")
    bad = materialize(boilerplate(lines, min_sites), "boilerplate")
    hits = lines.join(bad, ["l1", "l2"]).select("__t1", "__t2", "pos").distinct().groupBy("__t1", "__t2").agg(F.collect_list("pos").alias("__bad"))
    hits = materialize(hits, "hits")  # so that the join below has no aggregate beside it and a hot text can be split
    marked = df.withColumn("__t1", h1).withColumn("__t2", h2).join(hits, ["__t1", "__t2"], "left")
    parts = F.split(F.col(text), "\n")
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("__bad", i)), "\n")
    return marked.select(
        *[F.when(F.col("__bad").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text else F.col(c) for c in names],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("int").alias("n_lines"),
        F.coalesce(F.size("__bad"), F.lit(0)).cast("int").alias("n_removed"),
    )


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "n_lines", "n_removed", "text")


OP2_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents
), l AS (
  SELECT rid, coalesce('s' || source, 'n') AS site, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM d WHERE text IS NOT NULL
), b AS (
  SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 8
), m AS (
  SELECT l.rid, count(b.line)::INT AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE b.line IS NULL), '') AS text
  FROM l LEFT JOIN b ON l.line = b.line GROUP BY l.rid
)
SELECT d.doc_id, coalesce(len(d.parts), 0)::INT AS n_lines, coalesce(m.n_removed, 0)::INT AS n_removed, m.text
FROM d LEFT JOIN m ON d.rid = m.rid
"""
