"""Entity pages: donor rows, overlaps, relationships, comparison, scrubbing, profiles."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import PROFILE_STOP_WORDS, profile_address, profile_name, set_similarity, tokens, zip5
from ledgerlens.operators.matching import overlap_join


def donor_rows(receipts: DataFrame, private: Column) -> DataFrame:
    """One row per (donor, committee); the place of donors with any private row is redacted."""
    out = receipts.groupBy("donor_key", "committee_id").agg(
        F.min("donor_name").alias("donor_name"), F.round(F.sum("amount"), 2).alias("total_amount"), F.count("*").alias("n"), F.bool_or(private).alias("__private"), F.min("city").alias("city")
    )
    kind = F.when(F.col("donor_name").ilike("%customer%"), "organization").otherwise("person")
    return out.select("donor_key", "committee_id", "donor_name", kind.alias("donor_class"), "total_amount", "n", F.when(F.col("__private"), "redacted").otherwise(F.col("city")).alias("city"))


def multi_group_donors(receipts: DataFrame, least: int = 2) -> DataFrame:
    """Donors with money in at least `least` groups."""
    own = receipts.groupBy("donor_key", "committee_id").agg(F.round(F.sum("amount"), 2).alias("x"))
    return own.groupBy("donor_key").agg(F.count("*").alias("groups"), F.round(F.sum("x"), 2).alias("total_amount")).where(F.col("groups") >= least)


def relationships(receipts: DataFrame, inside: Column, pool: int = 2000, least: int = 2) -> DataFrame:
    """Outside committees that share at least `least` of the entity's largest donors (a pool that is part of the definition)."""
    donors = receipts.where(inside).groupBy("donor_key").agg(F.round(F.sum("amount"), 2).alias("s")).orderBy(F.desc("s"), "donor_key").limit(pool).select("donor_key")
    rows = receipts.where(~inside).join(F.broadcast(donors), "donor_key", "left_semi")
    out = rows.groupBy("committee_id").agg(F.countDistinct("donor_key").alias("shared_donors"), F.round(F.sum("amount"), 2).alias("amount"))
    return out.where(F.col("shared_donors") >= least)


def compare(receipts: DataFrame, left: Column, right: Column) -> DataFrame:
    """Donors of both sides with the smaller of their two sums; one pass over the receipts."""
    sums = receipts.where(left | right).groupBy("donor_key").agg(F.round(F.sum(F.when(left, F.col("amount"))), 2).alias("left_amount"), F.round(F.sum(F.when(right, F.col("amount"))), 2).alias("right_amount"))
    return sums.where("left_amount IS NOT NULL AND right_amount IS NOT NULL").withColumn("shared", F.least("left_amount", "right_amount"))


def scrub(df: DataFrame, rules: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """df with the columns of rows that match a rule replaced; rules are keys to hide, one row each."""
    marked = df.join(rules.select(*keys).distinct().withColumn("__hit", F.lit(True)), keys, "left")
    hit = F.coalesce("__hit", F.lit(False))
    return marked.select(*[F.when(hit, "redacted").otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns], hit.alias("scrubbed"))


def person_records(receipts: DataFrame) -> DataFrame:
    """One record per donor key for record linkage; the group is the name without its last digit."""
    out = receipts.groupBy("donor_key").agg(
        F.max("donor_name").alias("donor_name"), F.round(F.sum("amount"), 2).alias("total_amount"), F.max("city").alias("city"), F.max("state").alias("state"), F.max("occupation").alias("occupation")
    )
    number = F.regexp_extract("donor_name", r"(\d+)", 1)
    return out.select(
        "donor_key", "donor_name", F.regexp_replace("donor_name", r"\d$", "").alias("full_name"), "total_amount", F.concat(F.substring(number, 7, 2), F.lit(" main st")).alias("address"),
        "city", "state", F.substring(number, 5, 4).alias("zip"), F.concat("occupation", F.lit(" works")).alias("employer"), "occupation",
    )


def profile_pairs(profiles: DataFrame, least: float) -> DataFrame:
    """(src, dst, score): pairs of profiles whose score is at least `least`, compared if their names begin with the same telling word.

    Score: .6 name + .25 address + .15 officers. Name: 1 if equal without legal forms, else .6 token Jaccard + .4 sequence ratio. Address: 1 equal, .8 same zip, .6 same
    city and state. Officers: Jaccard of names. What address and officers can add at most bounds the Jaccard from below, so candidates come from the exact set join and
    no block of a common first word is paired; the sequence ratio runs on what is left.
    """
    have = profiles.columns
    opt = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    norm = profile_name(F.col("name"))
    officer = F.array_distinct(F.filter(F.transform(F.coalesce(opt("officers", "array<string>"), F.array().cast("array<string>")), profile_name), lambda x: F.coalesce(x, F.lit("")) != ""))
    rows = profiles.select(
        "id", norm.alias("n"), tokens(norm, PROFILE_STOP_WORDS).alias("tok"), F.coalesce(profile_address(opt("address")), F.lit("")).alias("a"), F.coalesce(F.lower(F.trim(opt("city"))), F.lit("")).alias("c"),
        F.coalesce(F.upper(F.trim(opt("state"))), F.lit("")).alias("s"), zip5(opt("zip")).alias("z"), officer.alias("o"),
    ).withColumn("block", F.get(F.filter(F.split("n", " "), lambda w: ~w.isin(PROFILE_STOP_WORDS)), F.lit(0)))
    name_least = (least - 0.40) / 0.60
    sets = rows.select("n", "tok", "block").where(F.size("tok") > 0).distinct()
    jaccard = max(0.05, (name_least - 0.4) / 0.6 - 1e-4)
    near = overlap_join(sets.select(F.col("n").alias("left_id"), F.col("tok").alias("tokens")), sets.select(F.col("n").alias("right_id"), F.col("tok").alias("tokens")), jaccard)
    side = lambda k: rows.where(F.size("tok") > 0).select(*[F.col(x).alias(f"{x}{k}") for x in rows.columns])
    pairs = near.select(F.col("left_id").alias("n1"), F.col("right_id").alias("n2")).join(side(1), "n1").join(side(2), "n2").where((F.col("id1") < F.col("id2")) & (F.col("block1") == F.col("block2")))
    full = lambda c: (F.col(f"{c}1") != "") & (F.col(f"{c}1") == F.col(f"{c}2"))
    place = F.when(full("a"), 1.0).when(full("z"), 0.8).when(full("c") & full("s"), 0.6).otherwise(0.0)
    j = set_similarity(F.col("tok1"), F.col("tok2"))
    rest = 0.25 * place + 0.15 * set_similarity(F.col("o1"), F.col("o2"))
    pairs = pairs.select(F.col("id1").alias("src"), F.col("id2").alias("dst"), "n1", "n2", j.alias("j"), rest.alias("rest")).where(0.6 * (0.6 * F.col("j") + 0.4) + F.col("rest") >= least - 1e-9)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            name = [1.0 if x == y else 0.6 * j + 0.4 * difflib.SequenceMatcher(None, x, y).ratio() for x, y, j in zip(rows["n1"], rows["n2"], rows["j"])]
            total = 0.6 * pd.Series(name, index=rows.index, dtype=float) + rows["rest"]
            yield rows.assign(score=total.round(4)).loc[total >= least - 1e-9, ["src", "dst", "score"]]

    kind = profiles.schema["id"].dataType.simpleString()
    return pairs.mapInPandas(score, f"src {kind}, dst {kind}, score double")


def resolve_profiles(profiles: DataFrame, merge: float = 0.92) -> DataFrame:
    """(id, profile): profiles joined by a shared id, or by a score of at least `merge` (see profile_pairs; from .85 on a pair is for review). The profile is the smallest id.

    Columns: id, name and, as far as they are there, shared_id, address, city, state, zip, officers (array). Null names match nothing.
    """
    from ledgerlens.operators.graph import components

    links = profile_pairs(profiles, merge).select("src", "dst")
    if "shared_id" in profiles.columns:
        hubs = profiles.where("shared_id IS NOT NULL").groupBy("shared_id").agg(F.min("id").alias("src"))
        links = links.unionByName(profiles.select("id", "shared_id").join(hubs, "shared_id").where("id <> src").select("src", F.col("id").alias("dst")))
    found = components(links)
    return profiles.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("profile"))
