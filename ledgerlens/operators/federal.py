"""Federal-style analytics: candidate totals, race analytics, outside spending pages, owners of transfers, donor detail, disaggregated edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def candidate_totals(candidates: DataFrame, receipts: DataFrame, links: DataFrame, outside: DataFrame) -> DataFrame:
    """One row per candidate: receipts of linked committees (each committee summed once), support and oppose; missing sums are zero."""
    sums = receipts.groupBy("committee_id").agg(F.sum("amount").alias("s"))
    money = links.join(sums, "committee_id").groupBy("candidate_id").agg(F.sum("s").alias("receipts"), F.count("*").alias("committees"))
    spent = outside.groupBy("candidate_id").agg(F.sum(F.when(F.col("supporting"), F.col("amount"))).alias("support"), F.sum(F.when(F.col("opposing"), F.col("amount"))).alias("oppose"))
    rows = candidates.join(money, "candidate_id", "left").join(spent, "candidate_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 2).alias(c)
    return rows.select("candidate_id", "race_key", zero("receipts"), F.coalesce("committees", F.lit(0)).alias("committees"), zero("support"), zero("oppose"))


def race_analytics(candidates: DataFrame, spending: DataFrame) -> DataFrame:
    """Per race: candidates with spending, payers, money, share of the largest payer."""
    rows = spending.join(candidates.select("candidate_id"), "candidate_id", "left_semi")
    per = rows.groupBy("race_key", "committee_id").agg(F.sum("amount").alias("s"), F.count("*").alias("n"))
    own = per.groupBy("race_key").agg(F.count("*").alias("payers"), F.round(F.sum("s"), 2).alias("money"), F.round(F.max("s") / F.sum("s"), 4).alias("top_payer_share"), F.sum("n").alias("payments"))
    return own.join(rows.groupBy("race_key").agg(F.countDistinct("candidate_id").alias("candidates")), "race_key")


def transfer_sources(receipts: DataFrame, is_transfer: Column, old: DataFrame | None = None) -> DataFrame:
    """Payers of transfers with their sums; the state of an earlier sync is kept by payer."""
    out = receipts.where(is_transfer).groupBy("donor_key").agg(F.round(F.sum("amount"), 2).alias("amount"), F.countDistinct("committee_id").alias("receivers"))
    return out if old is None else out.join(old, "donor_key", "left")


def donor_detail(receipts: DataFrame, donor_key: str) -> DataFrame:
    """One donor by committee and year, with subtotals in one pass."""
    own = receipts.where(F.col("donor_key") == donor_key)
    return own.groupBy("committee_id", F.year("received_date").cast("int").alias("year")).agg(F.round(F.sum("amount"), 2).alias("amount"), F.count("*").alias("n"))


def disaggregate(edges: DataFrame, links: DataFrame, amounts: DataFrame, n: int = 5) -> DataFrame:
    """Estimated donor to candidate money: a committee-candidate amount times each of the n largest donors' share, and the rest unattributed.

    edges: donor_key, committee_id, total_amount. amounts: committee_id, candidate_id, amount.
    """
    own = Window.partitionBy("committee_id")
    ranked = edges.where("total_amount > 0").withColumn("share", F.col("total_amount") / F.sum("total_amount").over(own)).withColumn("__n", F.row_number().over(own.orderBy(F.desc("total_amount"), "donor_key")))
    top = ranked.where(F.col("__n") <= n).select("committee_id", "donor_key", "share")
    known = amounts.join(links, ["committee_id", "candidate_id"], "left_semi")
    named = known.join(top, "committee_id").select("committee_id", "candidate_id", "donor_key", F.round(F.col("amount") * F.col("share"), 2).alias("estimated"))
    rest = known.join(top.groupBy("committee_id").agg(F.sum("share").alias("s")), "committee_id", "left")
    left = rest.select("committee_id", "candidate_id", F.lit("unattributed").alias("donor_key"), F.round(F.col("amount") * (1 - F.coalesce("s", F.lit(0.0))), 2).alias("estimated"))
    return named.unionByName(left)


def vendor_network(spending: DataFrame, top_committees: int = 20, top_vendors: int = 30, least: float = 1000.0) -> DataFrame:
    """Edges between the largest committees and vendors with at least `least` money."""
    rows = spending.where("d2_part IS NULL OR d2_part NOT LIKE '9%'").groupBy("committee_id", "payee_name").agg(F.round(F.sum("amount"), 2).alias("weight"), F.count("*").alias("n"))
    best = lambda key, k: rows.groupBy(key).agg(F.round(F.sum("weight"), 2).alias("t")).orderBy(F.desc("t"), key).limit(k).select(key)
    return rows.where(F.col("weight") >= least).join(F.broadcast(best("committee_id", top_committees)), "committee_id", "left_semi").join(F.broadcast(best("payee_name", top_vendors)), "payee_name", "left_semi")


def influence_edges(matches: DataFrame, edges: DataFrame, per_donor: int = 5) -> DataFrame:
    """Client to donor to committee edges: each matched donor keeps its largest committees; repeated edges add weights and keep the largest score.

    matches: client_id, donor_key, score.
    """
    kept = edges.withColumn("__n", F.row_number().over(Window.partitionBy("donor_key").orderBy(F.desc("total_amount"), "committee_id"))).where(F.col("__n") <= per_donor)
    a = matches.groupBy(F.concat(F.lit("client:"), F.col("client_id").cast("string")).alias("src"), F.concat(F.lit("donor:"), "donor_key").alias("dst")).agg(F.round(F.sum("score"), 4).alias("weight"), F.count("*").alias("n"), F.max("score").alias("score_max"))
    own = kept.join(matches.select("donor_key").distinct(), "donor_key", "left_semi")
    b = own.select(F.concat(F.lit("donor:"), "donor_key").alias("src"), F.concat(F.lit("committee:"), F.col("committee_id").cast("string")).alias("dst"), F.col("total_amount").alias("weight"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("double").alias("score_max"))
    return a.unionByName(b)


def entity_risk(recon: DataFrame, spikes: DataFrame, flags: DataFrame) -> DataFrame:
    """Risk rows of an entity with two severities: high from twice the rule's limit on."""
    level = lambda c, limit: F.when(F.col(c) >= 2 * limit, "high").otherwise("medium")
    a = spikes.select("committee_id", F.lit("spike").alias("kind"), F.col("ratio").alias("measure"), level("ratio", 3.0).alias("severity"))
    b = flags.select("committee_id", F.lit("concentration").alias("kind"), F.col("hhi").alias("measure"), level("hhi", 2500.0).alias("severity"))
    c = recon.where("status = 'mismatch'").select("committee_id", F.lit("reconciliation").alias("kind"), F.abs("difference").alias("measure"), level("difference", 10000.0).alias("severity"))
    return a.unionByName(b).unionByName(c)


def overlap_network(matches: DataFrame, edges: DataFrame, cap: int) -> DataFrame:
    """(edge_type, src, dst, weight): matched donors of both registers and the local ones' gifts to committees; the `cap` heaviest of each."""
    known = matches.select("donor_key").distinct()
    gifts = edges.join(known, "donor_key", "left_semi").select(F.lit("gift").alias("edge_type"), F.col("donor_key").alias("src"), F.concat(F.lit("committee:"), F.col("committee_id").cast("string")).alias("dst"), F.col("total_amount").alias("weight"))
    links = matches.select(F.lit("match").alias("edge_type"), F.col("federal_key").alias("src"), F.col("donor_key").alias("dst"), F.col("confidence").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("edge_type").orderBy(F.desc("weight"), "src", "dst"))
    return links.unionByName(gifts).withColumn("__n", rank).where(F.col("__n") <= cap).drop("__n")
