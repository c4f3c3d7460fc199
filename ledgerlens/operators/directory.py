"""Directories and lists: search, whitelisted sorts, pages, review queues, quality summaries, snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import name_matches
from ledgerlens.operators.geography import page
from ledgerlens.sources.shared import materialize


def sorted_by(columns: dict[str, str], name: str, direction: str = "asc", tie: str | None = None) -> list[Column]:
    """Sort order of a whitelisted column, nulls last either way, with a tiebreak; an unknown name falls back to the first column."""
    col = F.col(columns.get(name, next(iter(columns.values()))))
    order = [col.desc_nulls_last() if direction == "desc" else col.asc_nulls_last()]
    return order + ([F.col(tie).asc_nulls_last()] if tie else [])


def directory(df: DataFrame, search: str | None, name: str, columns: dict[str, str], sort: str, direction: str, size: int, number: int, tie: str, substring: bool = False) -> DataFrame:
    """Searched, sorted page. Words match name words by prefix; a search of four or more characters without any such match falls back to substrings.

    With `substring` every name that contains the search is found, whatever words begin with it.
    """
    rows = df
    if search:
        rows = df.where(F.lower(name).contains(search.lower()) if substring else name_matches(F.col(name), search))
        if not substring and len(search) >= 4 and rows.isEmpty():
            rows = df.where(F.lower(name).contains(search.lower()))
    return page(rows, sorted_by(columns, sort, direction, tie), size, number)


def site_search(sources: dict[str, tuple[DataFrame, str, str]], search: str, per_kind: int = 10) -> DataFrame:
    """(kind, id, name) over several tables, the first rows of each kind by name; each kind falls back to substrings by itself."""
    out = []
    for kind, (df, ids, name) in sources.items():
        hit = name_matches(F.col(name), search)
        if len(search) >= 4:
            hit = hit | F.lower(name).contains(search.lower())
        rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.lower("name"), "id"))
        rows = df.where(hit).select(F.lit(kind).alias("kind"), F.col(ids).cast("string").alias("id"), F.col(name).alias("name")).distinct()
        out.append(rows.withColumn("__n", rank).where(F.col("__n") <= per_kind).drop("__n"))
    return reduce(DataFrame.unionByName, out)


def review_queue(members: DataFrame, decided: DataFrame | None = None) -> DataFrame:
    """Entity status from member statuses: rejected if any is, accepted if all are, else open; earlier decisions carry over by donor key."""
    rows = members
    if decided is not None:
        rows = members.join(decided.select("donor_key", F.col("status").alias("__old")), "donor_key", "left").withColumn("status", F.coalesce("__old", "status")).drop("__old")
    status = F.when(F.bool_or(F.col("status") == "rejected"), "rejected").when(F.bool_and(F.col("status") == "accepted"), "accepted").otherwise("open")
    return rows.groupBy("entity_id").agg(status.alias("status"), F.count("*").alias("members"), F.sum(F.when(F.col("status") == "open", 1).otherwise(0)).alias("open_members"))


def quality_summary(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per check with the number and share of rows that fail it, from one pass."""
    parts = [F.struct(F.lit(name).alias("check"), F.count(F.when(test, 1)).alias("failed"), F.round(F.count(F.when(test, 1)) / F.count("*"), 6).alias("share")) for name, test in checks.items()]
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def content_upsert(old: DataFrame, new: DataFrame, link: str) -> DataFrame:
    """Rows of both by (link, content hash), each once."""
    both = old.unionByName(new)
    values = [c for c in both.columns if c != link]
    return both.withColumn("row_hash", F.sha1(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in values]).cast("binary"))).dropDuplicates([link, "row_hash"])


def infer_links(links: DataFrame, candidates: DataFrame, committees: DataFrame, tile: int = 4096) -> DataFrame:
    """New (committee, candidate) links where a committee's referred name equals `last, first` of a candidate, less the known links.

    Pairs are made last and never shuffled: the candidates of a name are arrays of about `tile` ids, from which a committee's known links are taken before its
    pairs are made. Only candidates with several names can meet a committee twice; their pairs are made distinct.
    """
    named = candidates.select("candidate_id", F.lower(F.concat_ws(", ", F.trim("last_name"), F.trim("first_name"))).alias("__k")).distinct()
    whom = committees.select("committee_id", F.lower(F.trim("refer_name")).alias("__k")).where("__k IS NOT NULL").distinct()
    named = named.withColumn("__names", F.count("*").over(Window.partitionBy("candidate_id")))
    several = whom.join(named.where("__names > 1"), "__k").select("committee_id", "candidate_id").distinct().join(links, ["committee_id", "candidate_id"], "left_anti")
    one = named.where("__names = 1").drop("__names")
    tiles = one.groupBy("__k").agg(F.ceil(F.count("*") / tile).alias("__n")).join(whom.groupBy("__k").agg(F.ceil(F.count("*") / tile).alias("__m")), "__k")
    deal = lambda df, c, n: df.join(tiles, "__k").withColumn(f"__{c}", F.pmod(F.xxhash64(c), F.col(n)))
    every = lambda c, n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(c)
    at = ["__k", "__candidate_id", "__committee_id"]
    dealt = deal(one, "candidate_id", "__n")
    lists = dealt.groupBy("__k", "__candidate_id", "__m").agg(F.collect_list("candidate_id").alias("__ids")).select("__k", "__candidate_id", "__ids", every("__committee_id", "__m"))
    known = links.join(whom, "committee_id").join(dealt.select("candidate_id", "__k", "__candidate_id"), ["candidate_id", "__k"])
    known = known.groupBy("committee_id", "__k", "__candidate_id").agg(F.collect_set("candidate_id").alias("__known"))
    rows = deal(whom, "committee_id", "__m").select("committee_id", "__k", "__committee_id", every("__candidate_id", "__n")).join(known, ["committee_id", "__k", "__candidate_id"], "left")
    new = F.when(F.col("__known").isNull(), F.col("__ids")).otherwise(F.array_except("__ids", "__known"))
    return rows.join(lists, at).select("committee_id", F.explode(new).alias("candidate_id")).unionByName(several)


def snapshot(df: DataFrame, label: str) -> DataFrame:
    """A stored copy of a result, for pages that are read many times."""
    return materialize(df, label)


def vendor_rank(df: DataFrame, name: str, query: str) -> DataFrame:
    """Match score of vendor names: exact 1.0, prefix .9, one a prefix word of the other .85, contained .5, else token Jaccard."""
    from ledgerlens.functions.text import normalize_name, set_similarity, tokens

    own, key = normalize_name(F.col(name)), normalize_name(F.lit(query))
    first = F.get(F.split(own, " "), F.lit(0))
    score = (
        F.when(own == key, 1.0).when(F.startswith(own, key), 0.9).when((first != "") & F.startswith(key, first), 0.85).when(F.contains(own, key), 0.5)
        .otherwise(set_similarity(tokens(F.col(name)), tokens(F.lit(query))))
    )
    return df.withColumn("score", F.round(score, 4)).where("score > 0")
