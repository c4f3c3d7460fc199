"""Named newsroom reports as operators: each takes its tables, year and limits as parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fine() -> Column:
    """Rows whose amount isn't marked as odd; no mark counts as fine."""
    return ~F.coalesce(F.col("anomalous"), F.lit(False))


def in_year(day: str, *years: int) -> Column:
    return F.year(day).isin(*years)


def is_transfer() -> Column:
    return F.lower("purpose").contains("contribution")


def is_vendor() -> Column:
    """Purposes that are no contribution; null purposes are neither."""
    return ~F.lower("purpose").contains("ontribution")


def dominance(edges: DataFrame, names: DataFrame, share: float = 0.75, least: float = 500_000.0, limit: int = 25) -> DataFrame:
    """Donors who gave more than `share` of a committee's money, for committees above `least`."""
    totals = edges.groupBy("committee_id").agg(F.round(F.sum("total_amount"), 2).alias("committee_total")).where(F.col("committee_total") > least)
    found = edges.join(totals, "committee_id").where(F.col("total_amount") / F.col("committee_total") > share).join(names, "committee_id")
    pct = F.round(100.0 * F.col("total_amount") / F.col("committee_total"), 1)
    out = found.select("committee_id", "committee_name", "donor_name", F.col("total_amount").alias("donor_total"), "contribution_count", "committee_total", pct.alias("pct_of_total"))
    return out.orderBy(F.desc("donor_total"), "committee_id", "donor_name").limit(limit)


def payees(spending: DataFrame, limit: int | None = None, least_committees: int = 1) -> DataFrame:
    """Payees by money with payments and paying committees."""
    out = spending.groupBy("payee_name").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total_amount"), F.countDistinct("committee_id").alias("committees")).where(F.col("committees") >= least_committees)
    return out.orderBy(F.desc("total_amount"), "payee_name").limit(limit) if limit else out


def growth(spending: DataFrame, before: int, after: int, least: float = 50_000.0, limit: int = 20) -> DataFrame:
    """Payees above `least` in both years, by the ratio of the later to the earlier."""
    sums = [F.round(F.sum(F.when(in_year("expended_date", y), F.col("amount"))), 2).alias(n) for y, n in ((before, "before"), (after, "after"))]
    out = spending.groupBy("payee_name").agg(*sums).where((F.col("before") > least) & (F.col("after") > least))
    return out.withColumn("ratio", F.round(F.col("after") / F.col("before"), 2)).orderBy(F.desc("ratio"), "payee_name").limit(limit)


def size_trend(receipts: DataFrame, *years: int) -> DataFrame:
    """Gifts per year in four bands of size, and the money of the largest band."""
    rows = receipts.where((F.col("amount") > 0) & in_year("received_date", *years))
    count = lambda low, high: F.sum(F.when((F.col("amount") >= low) & (F.col("amount") < high), 1).otherwise(0)).cast("long")
    mega = F.round(F.coalesce(F.sum(F.when(F.col("amount") >= 50_000, F.col("amount"))), F.lit(0.0)), 2)
    far = float("inf")
    return rows.groupBy(F.year("received_date").alias("year")).agg(count(-far, 150).alias("under_150"), count(150, 1_000).alias("mid"), count(1_000, 50_000).alias("large"), count(50_000, far).alias("mega"), mega.alias("mega_total"))


def race_finance(candidates: DataFrame, links: DataFrame, committees: DataFrame, receipts: DataFrame, spending: DataFrame, office: str, year: int) -> DataFrame:
    """Candidates of an office with each linked committee's receipts, spending and funds in a year; a committee is summed once."""
    money = receipts.where(in_year("received_date", year)).groupBy("committee_id").agg(F.round(F.sum("amount"), 2).alias("receipts"))
    spent = spending.where(in_year("expended_date", year)).groupBy("committee_id").agg(F.round(F.sum("amount"), 2).alias("expenditures"))
    rows = candidates.where(F.col("office") == office).join(links, "candidate_id").join(committees, "committee_id").join(money, "committee_id", "left").join(spent, "committee_id", "left")
    return rows.select("candidate_id", "candidate_name", "committee_name", "receipts", "expenditures", F.col("funds").alias("ending_funds"))


def stockpiles(receipts: DataFrame, spending: DataFrame, committees: DataFrame, year: int, least: float = 100_000.0, limit: int = 15) -> DataFrame:
    """Committees that took more than `least` in a year and spent nothing (rows of odd amounts don't count as spending)."""
    took = receipts.where(in_year("received_date", year)).groupBy("committee_id").agg(F.round(F.sum("amount"), 2).alias("total_receipts")).where(F.col("total_receipts") > least)
    spent = spending.where(in_year("expended_date", year) & fine()).select("committee_id").distinct()
    out = took.join(spent, "committee_id", "left_anti").join(committees.select("committee_id", "committee_name"), "committee_id")
    return out.orderBy(F.desc("total_receipts"), "committee_id").limit(limit)


#: Classes of purposes in order, with the parts of words that decide; the first that occurs wins.
PURPOSES = [
    ("Contribution/Transfer", ["ontribution"]),
    ("Media/Advertising", ["advertis", "media", "tv"]),
    ("Consulting", ["consult"]),
    ("Payroll/Salary", ["salary", "payroll"]),
    ("Fundraising", ["fundrais"]),
    ("Rent", ["rent"]),
    ("Legal", ["legal"]),
    ("Travel", ["travel", "hotel"]),
    ("Print/Mail", ["print", "mail"]),
]


def purpose_breakdown(spending: DataFrame, year: int) -> DataFrame:
    low, out = F.lower("purpose"), None
    for name, words in PURPOSES:
        test = F.lit(False)
        for w in words:
            test = test | F.coalesce(low.contains(w), F.lit(False))
        out = F.when(test, name) if out is None else out.when(test, name)
    rows = spending.where(in_year("expended_date", year) & fine())
    return rows.groupBy(out.otherwise("Other").alias("category")).agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total_amount"))


def competitive(totals: DataFrame, least: float = 100_000.0, candidates: int = 3) -> DataFrame:
    """Races with at least three candidates whose receipts are above `least`, with their receipts together."""
    own = totals.where(F.col("receipts") > least).groupBy("race_key").agg(F.count("*").alias("candidates"), F.round(F.sum("receipts"), 2).alias("combined_receipts"))
    return own.where(F.col("candidates") >= candidates)


def both_systems(matches: DataFrame, least: float = 0.9, limit: int = 25) -> DataFrame:
    """Donors of both registers, matched with a confidence of at least `least`, by their money together."""
    rows = matches.where(F.col("confidence") >= least).withColumn("combined", F.round(F.col("federal_total") + F.col("local_total"), 2))
    return rows.orderBy(F.desc("combined"), "federal_key", "donor_key").limit(limit)


def receipt_gaps(reported: DataFrame, itemized: DataFrame, least: float = 500.0, limit: int = 10_000) -> DataFrame:
    """Which committees to load again first: reported minus itemized receipts by the size of the gap; committees without any row count as a whole gap."""
    rows = reported.join(itemized, "committee_id", "left").withColumn("gap", F.round(F.col("reported") - F.coalesce("itemized", F.lit(0.0)), 2)).where(F.abs("gap") >= least)
    return rows.select("committee_id", "reported", F.coalesce("itemized", F.lit(0.0)).alias("itemized"), "gap").orderBy(F.desc(F.abs("gap")), "committee_id").limit(limit)


def merge_officers(current: DataFrame, previous: DataFrame, links: DataFrame) -> DataFrame:
    """Officers of both tables with `is_current`; those without a committee get it from the links by officer."""
    both = current.withColumn("is_current", F.lit(True)).unionByName(previous.withColumn("is_current", F.lit(False)))
    found = links.select("officer_id", F.col("committee_id").alias("__c")).groupBy("officer_id").agg(F.min("__c").alias("__c"))
    return both.join(found, "officer_id", "left").withColumn("committee_id", F.coalesce("committee_id", "__c")).drop("__c")


def candidacy_feed(candidacies: DataFrame, links: DataFrame) -> DataFrame:
    """Candidacies with each linked committee and the cycle: odd years fold forward to the next even one. Those without a committee stay."""
    return candidacies.join(links, "candidate_id", "left").withColumn("cycle", (F.col("year") + F.col("year") % 2).cast("int"))
