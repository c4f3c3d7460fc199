"""Corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing and sharding, in this order.

Each stage reads what its predecessor kept and returns the columns of documents; the last adds shard and slot. Columns that a stage doesn't need
travel packed, so that a column of any name (score, items, size, ...) comes out as it went in; only the last stage replaces columns named shard or slot.
Null and empty texts are kept as clean; null ids, repeated rows and empty tables are allowed in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD, discard, id_crc, load, materialize
from ledgerlens.llm.decontamination import contaminated
from ledgerlens.llm.mixing import mix
from ledgerlens.llm.sharding import shard
from ledgerlens.llm.simhash import keep_one
from ledgerlens.llm.toxicity import score_texts, train


def _packed(docs: DataFrame, *needed: str) -> DataFrame:
    """docs with its needed columns and all others in one column `__rest`."""
    rest = [c for c in docs.columns if c not in needed]
    return docs.select(*needed, (F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(None)).alias("__rest"))


def _unpacked(df: DataFrame, columns: list[str], *needed: str) -> DataFrame:
    return df.select(*[F.col(c) if c in needed else F.col("__rest").getField(c).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject. Null and empty texts stay; without labels nothing is rejected."""
    labels = load(spark, sf_dir, "labels").where(F.pmod(id_crc("doc_id"), F.lit(5)) != 0)
    model, lexicon = train(docs, labels)
    return _unpacked(score_texts(_packed(docs, "text"), model, lexicon).where("predicted = 0"), docs.columns, "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest doc_id, of each group of linked fingerprints. All texts without words are one group."""
    return keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window. Null and empty texts have none; repeated rows stay repeated."""
    found = contaminated(_packed(docs, "text"), load(spark, sf_dir, "benchmark"))
    return _unpacked(found.where(F.size("spans") == 0), docs.columns, "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the text at which a source's budget ends is cut to the words that fit.

    Documents without words (null and empty texts too) cost nothing and stay once.
    """
    needed = ("doc_id", "source", "text")
    found = mix(_packed(docs, *needed))
    whole = F.col("epochs") + F.when(F.col("size") == 0, 1 - F.col("epochs")).otherwise((F.col("part") == F.col("size")).cast("long"))
    cut = (F.col("part") > 0) & (F.col("part") < F.col("size"))
    copies = F.when(cut, whole + 1).otherwise(whole).cast("int")
    rows = found.withColumn("__cut", cut).withColumn("__copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
    rows = rows.withColumn("__cut", F.col("__cut") & (F.col("__copy") > F.col("epochs")))
    short = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), F.lit(1), F.col("part").cast("int")), " ")
    rows = rows.withColumn("text", F.when(F.col("__cut"), short).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("__cut"), F.length("text").cast("long")).otherwise(F.col("__rest.n_chars"))
        rows = rows.withColumn("__rest", F.col("__rest").withField("n_chars", n_chars))
    return _unpacked(rows, docs.columns, *needed)


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot: every row once, shard sizes at most one row apart."""
    return shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)  # the tables of documents are no such table and stay
    return STAGES[-1][1](spark, docs, sf_dir)


#: The toxicity model and the fingerprints can't be expressed in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None
