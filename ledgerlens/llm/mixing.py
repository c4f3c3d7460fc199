"""Mix sources to target weights: hash-random order, distributed prefix sums, a cut at each exact budget."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD, fresh, load, materialize

#: Rows aimed at in one key range of one source.
ROWS = 50_000
#: Sources up to this many are put in order in one task; more are ranked in key ranges, with the same result.
SOURCES = 200_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes (one row per source: source, source_size) with `target`.

    Sources in code point order, null last, get the weights in turn. The total is share x all sizes; a target stops
    at cap x its source's size and the excess goes to the others by weight. This is water filling: with sources
    sorted by cap / weight, the level is the largest of (total - caps before) / (weights from here on).
    """
    position = Window.orderBy(F.col("source").asc_nulls_last())
    weight = lambda at: F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(at, F.lit(len(weights))).cast("int") + 1)
    capped = F.col("source_size") * F.lit(cap)
    if sizes.count() > SOURCES:
        return _many_targets(sizes.withColumn("__cap", capped), weight, share)
    table = sizes.withColumn("__w", weight(F.row_number().over(position) - 1)).withColumn("__cap", capped)
    level = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    table = (
        table.withColumn("__caps", F.sum("__cap").over(level.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__cap"))
        .withColumn("__ws", F.sum("__w").over(level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("__total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("__level", F.max((F.col("__total") - F.col("__caps")) / F.col("__ws")).over(everything))
    )
    return table.select("source", "source_size", F.least("__cap", F.col("__level") * F.col("__w")).alias("target"))


def _many_targets(sizes: DataFrame, weight, share: float) -> DataFrame:
    """The same without a task that holds all sources: ranks from key ranges and their counts, the level by raising it until no more sources stop at their caps."""
    ranged = sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("__p", F.spark_partition_id())
    ranged = materialize(ranged, "source-ranges")
    before = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    before = before.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(F.col("source").asc_nulls_last()))
    table = materialize(ranged.join(before, "__p").withColumn("__w", weight(F.col("__before") + inside - 1)), "source-weights")
    total = float(table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, stopped = 0.0, -1
    while True:
        over = F.col("__cap") < F.lit(level) * F.col("__w")
        caps, ws, n = table.agg(F.sum(F.when(over, F.col("__cap"))), F.sum(F.when(~over, F.col("__w"))), F.count(F.when(over, 1))).first()
        if n == stopped or not ws:
            break
        level, stopped = (total - (caps or 0.0)) / ws, n
    return table.select("source", "source_size", F.least("__cap", F.lit(level) * F.col("__w")).alias("target"))


def _ranges(rows: DataFrame, digits: int) -> DataFrame:
    """rows with `__range` (a key range in hash order) and `__rid` (order of rows that are equal otherwise).

    A range is a prefix of the key. Where a range is far above ROWS although the prefix is long enough, one key repeats: then the rows are stored with a
    number, and the whole key, the size and the stored row's partition cut the range further, in the same order, so that no hot id meets in one task.
    """
    prefix = F.substring("__key", 1, digits)
    crowded = rows.groupBy(F.col("__source").alias("__s"), prefix.alias("__p")).agg(F.count("*").alias("__n")).where(F.col("__n") > 8 * ROWS)
    if crowded.isEmpty():
        return rows.withColumn("__range", prefix).withColumn("__rid", F.lit(0).cast("long"))
    rows = materialize(rows.withColumn("__rid", F.monotonically_increasing_id()), "mix")
    marked = rows.join(crowded, F.col("__source").eqNullSafe(F.col("__s")) & (prefix == F.col("__p")), "left")
    width = lambda c, n: F.lpad(c.cast("string"), n, "0")
    finer = F.concat(F.col("__key"), F.lit(":"), F.coalesce(F.col("__ids"), F.lit("")), F.lit(":"), width(F.col("size"), 19), width(F.shiftright("__rid", 33), 10))
    return marked.withColumn("__range", F.when(F.col("__n").isNotNull(), finer).otherwise(prefix)).drop("__s", "__p", "__n")


def mix(df: DataFrame, source: str = "source", text: str = "text", ids: tuple[str, ...] = ("doc_id",), weights=(3, 1, 2), share=1.5, cap=2.0, seed: str = "mix", words: str | None = None) -> DataFrame:
    """df with `size`, `source_size`, `target`, `taken`, `epochs`, `part` and `first_word`.

    A row's size is its number of words (null or empty text: 0), or the column `words` if that is named. Rows of a source are put in the order of an md5 of
    the seed and the ids, then ids and size; the source's budget is its target rounded down. Whole epochs come first
    (`epochs` times every row), then the rows in order until the budget ends: `part` (0 to size) words of a row,
    cut inside the row at which it ends. taken = epochs x size + part. A null source is a source of its own; null ids count as
    the text `null`; equal rows are interchangeable; sources without words take nothing; an empty df gives an empty result.
    Columns with the added names are replaced.
    """
    added = ("size", "source_size", "target", "taken", "epochs", "part", "first_word")
    names = [c for c in fresh(df, *added).columns]
    key = F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(i).cast("string"), F.lit("null")) for i in ids]))
    together = F.concat_ws("\x1f", *[F.coalesce(F.col(i).cast("string"), F.lit("")) for i in ids])
    size = n_words(F.col(text)) if words is None else F.coalesce(F.col(words), F.lit(0)).cast("long")
    keyed = df.select(*names, F.col(source).alias("__source"), size.alias("size"), key.alias("__key"), together.alias("__ids"))
    digits = max(2, math.ceil(math.log(max(1, df.count() / ROWS), 16)))
    rows = _ranges(keyed, digits)
    ranges = materialize(rows.groupBy("__source", "__range").agg(F.sum("size").alias("__size")), "mix-ranges")
    goals = targets(ranges.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size")), weights, share, cap)
    before = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    offsets = (
        ranges.withColumn("__from", F.sum("__size").over(before) - F.col("__size")).drop("__size")
        .join(goals.withColumnRenamed("source", "__goal"), F.col("__source").eqNullSafe(F.col("__goal")))
        .select(F.col("__source").alias("__s"), F.col("__range").alias("__r"), "__from", "source_size", "target")
    )
    inside = Window.partitionBy("__source", "__range").orderBy("__key", "__ids", "size", "__rid").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__upto", F.sum("size").over(inside))
    rows = rows.join(offsets, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")))
    budget = F.floor("target").cast("long")
    rows = rows.withColumn("first_word", F.col("__from") + F.col("__upto") - F.col("size"))
    rows = rows.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long"))
    rest = budget - F.col("epochs") * F.col("source_size") - F.col("first_word")
    rows = rows.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest)))
    rows = rows.withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
    return rows.select(*names, *added)


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("words"))
    docs = materialize(docs, "words")  # texts are read and counted once
    return mix(docs, words="words").select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)] AS w,
         source_size * 2.0::DOUBLE AS cap
  FROM s
), l AS (
  SELECT *, sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap AS caps,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total
  FROM w
), t AS (
  SELECT source, source_size, least(cap, (max((total - caps) / ws) OVER ()) * w) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS first_word,
         floor(t.target)::BIGINT AS budget,
         CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - first_word)))::BIGINT AS taken
FROM p
"""
