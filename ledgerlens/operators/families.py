"""Families of committees: pairs with a shared candidate and a second sign, their connected sets, and weak pairs for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import set_similarity, trigrams
from ledgerlens.operators.graph import components
from ledgerlens.operators.matching import trigram_pairs

THRESHOLD = 0.8


def norm(c: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]+", " "))


def officers(committees: DataFrame, officer: str = "officer") -> DataFrame:
    """(committee_id, officers): distinct lower-case names per committee."""
    rows = committees.select("committee_id", F.lower(F.trim(officer)).alias("o")).where("o <> ''")
    return rows.groupBy("committee_id").agg(F.collect_set("o").alias("officers"))


def linked_pairs(links: DataFrame) -> DataFrame:
    """(c1, c2), c1 < c2, of committees that share a candidate. A candidate's committees are few by nature; their list is built once per candidate."""
    own = links.groupBy("candidate_id").agg(F.array_sort(F.collect_set("committee_id")).alias("cs")).where(F.size("cs") > 1)
    first = own.select("cs", F.posexplode("cs").alias("i", "c1"))
    return first.select("c1", F.explode(F.slice("cs", F.col("i") + 2, F.size("cs"))).alias("c2")).distinct()


def strong_pairs(committees: DataFrame, links: DataFrame, officers: DataFrame, name: str = "committee_name", street: str = "street", zip_code: str = "zip") -> DataFrame:
    """Pairs with a shared candidate that also have equal names, similar names (trigrams), one address (street and zip) or a common officer, with the four signs."""
    own = committees.select(F.col("committee_id"), norm(name).alias("n"), trigrams(norm(name)).alias("t"), norm(street).alias("s"), norm(zip_code).alias("z")).join(officers, "committee_id", "left")
    side = lambda k: own.select(*[F.col(c).alias(f"{c}{k}" if c != "committee_id" else f"c{k}") for c in own.columns])
    rows = linked_pairs(links).join(side(1), "c1").join(side(2), "c2")
    signs = {
        "same_name": (F.col("n1") != "") & (F.col("n1") == F.col("n2")),
        "similar_name": set_similarity(F.col("t1"), F.col("t2")) >= THRESHOLD,
        "same_address": (F.col("s1") != "") & (F.col("s1") == F.col("s2")) & (F.col("z1") == F.col("z2")),
        "shared_officer": F.coalesce(F.arrays_overlap("officers1", "officers2"), F.lit(False)),
    }
    found = rows.select("c1", "c2", *[v.alias(k) for k, v in signs.items()])
    return found.where("same_name OR similar_name OR same_address OR shared_officer")


def weak_pairs(committees: DataFrame, links: DataFrame, name: str = "committee_name", zip_code: str = "zip") -> DataFrame:
    """Pairs in one zip with similar names but no shared candidate, for review."""
    rows = committees.select("committee_id", norm(name).alias("n"), F.nullif(F.col(zip_code), F.lit("")).alias("z"))
    near = trigram_pairs(rows, "committee_id", "n", THRESHOLD, ["z"]).select(F.col("left_id").alias("c1"), F.col("right_id").alias("c2"), F.round("score", 3).alias("sim"))
    return near.join(linked_pairs(links), ["c1", "c2"], "left_anti")


def families(pairs: DataFrame) -> DataFrame:
    """(committee_id, family_id, member_hash): connected pairs; the smallest member names the family, the hash its members."""
    found = components(pairs.select(F.col("c1").alias("src"), F.col("c2").alias("dst"))).select(F.col("node").alias("committee_id"), F.col("component").alias("family_id"))
    members = found.groupBy("family_id").agg(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list("committee_id")), lambda x: x.cast("string")), ",").cast("binary")).alias("member_hash"))
    return found.join(members, "family_id").select("committee_id", "family_id", "member_hash")
