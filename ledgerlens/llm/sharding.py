"""Uniform shuffle into shards by an exact hypergeometric communication matrix (DataFrame operations only).

1. Rows are dealt to P working partitions by a hash of a stored row id.
2. From the P partition counts the driver draws the P x S matrix of how many rows each partition sends to each
   shard: sequential hypergeometric draws, so that row and column sums are exact and every assignment is
   equally likely. The matrix is bounded by MATRIX cells, whatever the input.
3. Each partition is permuted locally; the matrix row cuts the permutation into shard runs.
4. After the exchange each shard is permuted again: a random key is ranked in key ranges, and the range counts
   give the offsets, so that no task ever holds a shard.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import fresh, load, materialize, partitions

#: Most cells of the communication matrix, which is broadcast.
MATRIX = 262_144
#: Rows aimed at in one working partition or key range.
ROWS = 200_000


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of `sample` rows drawn without replacement from good + bad are good: inversion around the mode."""
    low, high = max(0, sample - bad), min(good, sample)
    if low >= high:
        return low
    total = good + bad
    mode = min(max((good + 1) * (sample + 1) // (total + 2), low), high)
    spread = math.sqrt(max(sample * (good / total) * (bad / total) * ((total - sample) / max(total - 1, 1)), 1.0))
    left, right = max(low, mode - int(14 * spread) - 30), min(high, mode + int(14 * spread) + 30)
    k = np.arange(left, right, dtype=np.float64)
    step = np.log(good - k) + np.log(sample - k) - np.log(k + 1) - np.log(bad - sample + k + 1)
    logp = np.concatenate(([0.0], np.cumsum(step)))
    cdf = np.cumsum(np.exp(logp - logp.max()))
    return left + int(np.searchsorted(cdf, rng.random() * cdf[-1], side="right").clip(0, right - left))


def communication_matrix(counts: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Rows per (partition, shard): row sums are counts, column sums differ by one at most."""
    rng, total = np.random.default_rng(seed), sum(counts)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = []
    for n in counts:
        left, rest, row = n, sum(room), []
        for s in range(n_shards):
            rest -= room[s]
            take = draw_hypergeometric(rng, room[s], rest, left)
            row.append(take)
            left -= take
        room = [r - t for r, t in zip(room, row)]
        matrix.append(row)
    return matrix


def shard(df: DataFrame, n_shards: int = 16, seed: int = 20) -> DataFrame:
    """df with `shard` (int, 0 to n_shards - 1) and `slot` (long, gapless from 0 in its shard).

    Every row of df is dealt exactly once, nulls, empty texts and repeated rows included; shard sizes differ by
    one row at most. Columns named shard or slot are replaced. An empty df gives an empty result. The rows
    are stored once with a row id, so that a recomputed task finds the same assignment.
    """
    spark = df.sparkSession
    names = [c for c in fresh(df, "shard", "slot").columns]
    rid = "__rid"
    base = materialize(df.select(*names).withColumn(rid, F.monotonically_increasing_id()), "shard")
    total = base.count()
    n_parts = max(1, min(MATRIX // n_shards, max(partitions(spark), math.ceil(total / ROWS))))
    dealt = base.select(rid).withColumn("__part", F.pmod(F.xxhash64(F.lit(seed), F.col(rid)), F.lit(n_parts)).cast("int"))
    found = {r["__part"]: r["n"] for r in dealt.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    matrix = communication_matrix([found.get(p, 0) for p in range(n_parts)], n_shards, seed)
    # The matrix goes in as one literal and is read by the JVM: no Python rows on the data's path.
    table = json.dumps([{"__part": p, "__ends": np.cumsum(row).tolist()} for p, row in enumerate(matrix)])
    ends = spark.range(1).select(F.inline(F.from_json(F.lit(table), "array<struct<__part:int,__ends:array<bigint>>>")))
    local = Window.partitionBy("__part").orderBy(F.xxhash64(F.lit(seed + 1), F.col(rid)), F.col(rid))
    ranked = dealt.withColumn("__rank", F.row_number().over(local).cast("long") - 1)
    sent = ranked.join(F.broadcast(ends), "__part").select(
        rid, F.size(F.filter("__ends", lambda e: e <= F.col("__rank"))).cast("int").alias("shard")
    )
    bits = max(0, math.ceil(math.log2(max(1, total / n_shards / ROWS, partitions(spark) / n_shards))))
    key = F.xxhash64(F.lit(seed + 2), F.col(rid))
    sent = sent.withColumn("__key", key).withColumn("__range", F.shiftrightunsigned("__key", 64 - bits).cast("int") if bits else F.lit(0))
    sent = materialize(sent, "sent")
    offsets = (
        sent.groupBy("shard", "__range").agg(F.count("*").alias("__n"))
        .withColumn("__from", F.sum("__n").over(Window.partitionBy("shard").orderBy("__range")) - F.col("__n"))
        .drop("__n")
    )
    again = Window.partitionBy("shard", "__range").orderBy("__key", rid)
    placed = (
        sent.withColumn("__rank", F.row_number().over(again).cast("long") - 1)
        .join(offsets, ["shard", "__range"])
        .select(rid, "shard", (F.col("__from") + F.col("__rank")).alias("slot"))
    )
    return base.join(placed, rid).select(*names, "shard", "slot")


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
