"""Newsroom reports: operators of the library against SQL written apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import text
from ledgerlens.operators import federal, matching, reports
from ledgerlens.plans.catalog import query
from ledgerlens.plans.queries_core import EDGES, GOOD, edges, good

_FINE = "(anomalous = FALSE OR anomalous IS NULL)"
_Y99 = "expended_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'"


@query("single_donor_dominance", f"WITH {EDGES}, t AS (SELECT committee_id, round(sum(total_amount), 2) AS total FROM e GROUP BY 1 HAVING round(sum(total_amount), 2) > 500000) SELECT committee_id, s_name AS committee_name, donor_name, total_amount AS donor_total, contribution_count, total AS committee_total, round(100.0 * total_amount / total, 1) AS pct_of_total FROM e JOIN t USING (committee_id) JOIN supplier ON s_suppkey = committee_id WHERE total_amount / total > 0.008 ORDER BY donor_total DESC, committee_id, donor_name LIMIT 25")
def _(t):
    return reports.dominance(edges(t), t.committees.select("committee_id", "committee_name"), share=0.008)


@query("committee_transfers_year", f"SELECT payee_name, count(*) AS n, round(sum(amount), 2) AS total_amount, count(DISTINCT committee_id) AS committees FROM expenditures WHERE {_Y99} AND {_FINE} AND purpose ILIKE '%contribution%' GROUP BY 1 ORDER BY total_amount DESC, payee_name LIMIT 30")
def _(t):
    return reports.payees(t.expenditures.where(reports.in_year("expended_date", 1999) & reports.fine() & reports.is_transfer()), 30)


@query("top_vendors_year", f"SELECT payee_name, count(*) AS n, round(sum(amount), 2) AS total_amount, count(DISTINCT committee_id) AS committees FROM expenditures WHERE {_Y99} AND {_FINE} AND purpose NOT ILIKE '%ontribution%' GROUP BY 1 ORDER BY total_amount DESC, payee_name LIMIT 30")
def _(t):
    return reports.payees(t.expenditures.where(reports.in_year("expended_date", 1999) & reports.fine() & reports.is_vendor()), 30)


@query("shared_vendors", f"SELECT payee_name, count(*) AS n, round(sum(amount), 2) AS total_amount, count(DISTINCT committee_id) AS committees FROM expenditures WHERE {_Y99} AND {_FINE} AND purpose NOT ILIKE '%ontribution%' GROUP BY 1 HAVING count(DISTINCT committee_id) >= 10")
def _(t):
    return reports.payees(t.expenditures.where(reports.in_year("expended_date", 1999) & reports.fine() & reports.is_vendor()), least_committees=10)


@query("vendor_growth_yoy", f"WITH b AS (SELECT payee_name, round(sum(amount), 2) AS before FROM expenditures WHERE year(expended_date) = 1998 AND {_FINE} AND purpose NOT ILIKE '%ontribution%' GROUP BY 1 HAVING round(sum(amount), 2) > 50000), a AS (SELECT payee_name, round(sum(amount), 2) AS after FROM expenditures WHERE year(expended_date) = 1999 AND {_FINE} AND purpose NOT ILIKE '%ontribution%' GROUP BY 1 HAVING round(sum(amount), 2) > 50000) SELECT payee_name, before, after, round(after / before, 2) AS ratio FROM a JOIN b USING (payee_name) ORDER BY ratio DESC, payee_name LIMIT 20")
def _(t):
    return reports.growth(t.expenditures.where(reports.fine() & reports.is_vendor()), 1998, 1999)


@query("small_dollar_trend", "SELECT year(received_date)::INT AS year, count(*) FILTER (WHERE amount < 150) AS under_150, count(*) FILTER (WHERE amount >= 150 AND amount < 1000) AS mid, count(*) FILTER (WHERE amount >= 1000 AND amount < 50000) AS large, count(*) FILTER (WHERE amount >= 50000) AS mega, round(coalesce(sum(amount) FILTER (WHERE amount >= 50000), 0), 2) AS mega_total FROM receipts WHERE amount > 0 AND year(received_date) IN (1998, 1999, 2000) GROUP BY 1")
def _(t):
    return reports.size_trend(t.receipts, 1998, 1999, 2000)


@query("race_year", f"WITH r AS (SELECT committee_id, round(sum(amount), 2) AS receipts FROM receipts WHERE year(received_date) = 1999 AND {GOOD} GROUP BY 1), x AS (SELECT committee_id, round(sum(amount), 2) AS expenditures FROM expenditures WHERE year(expended_date) = 1999 GROUP BY 1) SELECT k.candidate_id, k.candidate_name, c.committee_name, r.receipts, x.expenditures, c.funds AS ending_funds FROM candidates k JOIN links l ON k.candidate_id = l.candidate_id JOIN committees c ON c.committee_id = l.committee_id LEFT JOIN r ON r.committee_id = c.committee_id LEFT JOIN x ON x.committee_id = c.committee_id WHERE k.office = 'PROMO'")
def _(t):
    return reports.race_finance(t.candidates, t.links, t.committees, good(t), t.expenditures, "PROMO", 1999)


@query("pure_stockpile_committees", f"SELECT c.committee_id, c.committee_name, round(sum(r.amount), 2) AS total_receipts FROM receipts r JOIN committees c ON r.committee_id = c.committee_id WHERE year(r.received_date) = 1999 AND c.committee_id NOT IN (SELECT committee_id FROM expenditures WHERE {_Y99} AND {_FINE} AND d2_part = '8A' AND race_key = 'Brand#7' AND committee_id IS NOT NULL) GROUP BY ALL HAVING round(sum(r.amount), 2) > 100000 ORDER BY total_receipts DESC, c.committee_id LIMIT 15")
def _(t):
    return reports.stockpiles(t.receipts, t.expenditures.where("d2_part = '8A' AND race_key = 'Brand#7'"), t.committees, 1999)


@query("expenditure_purpose_breakdown", f"SELECT CASE WHEN purpose ILIKE '%ontribution%' THEN 'Contribution/Transfer' WHEN purpose ILIKE '%advertis%' OR purpose ILIKE '%media%' OR purpose ILIKE '%TV%' THEN 'Media/Advertising' WHEN purpose ILIKE '%consult%' THEN 'Consulting' WHEN purpose ILIKE '%salary%' OR purpose ILIKE '%payroll%' THEN 'Payroll/Salary' WHEN purpose ILIKE '%fundrais%' THEN 'Fundraising' WHEN purpose ILIKE '%rent%' THEN 'Rent' WHEN purpose ILIKE '%legal%' THEN 'Legal' WHEN purpose ILIKE '%travel%' OR purpose ILIKE '%hotel%' THEN 'Travel' WHEN purpose ILIKE '%print%' OR purpose ILIKE '%mail%' THEN 'Print/Mail' ELSE 'Other' END AS category, count(*) AS n, round(sum(amount), 2) AS total_amount FROM expenditures WHERE {_Y99} AND {_FINE} GROUP BY 1")
def _(t):
    return reports.purpose_breakdown(t.expenditures, 1999)


@query("competitive_races", f"WITH r AS (SELECT committee_id, sum(amount) AS s FROM receipts WHERE {GOOD} GROUP BY 1), k AS (SELECT race_key, c.candidate_id, round(coalesce(sum(s), 0), 2) AS receipts FROM candidates c LEFT JOIN links l ON c.candidate_id = l.candidate_id LEFT JOIN r ON r.committee_id = l.committee_id GROUP BY ALL) SELECT race_key, count(*) AS candidates, round(sum(receipts), 2) AS combined_receipts FROM k WHERE receipts > 100000 GROUP BY 1 HAVING count(*) >= 3")
def _(t):
    totals = federal.candidate_totals(t.candidates, good(t), t.links, t.expenditures.where("d2_part LIKE '9%'"))
    return reports.competitive(totals)


def federal_local(t):
    """Donors of both registers by name with zip, with city and state, or with state; at most three local donors each."""
    left = t.federal_donors.select("federal_key", "federal_name", "federal_total", text.normalize_name(F.col("federal_name")).alias("nm"), F.lower(F.trim("city")).alias("ci"), F.upper(F.trim("state")).alias("st"), text.zip5(F.col("zip")).alias("zp"))
    right = t.donor_book.select("donor_key", "donor_name", F.col("total_amount").alias("local_total"), text.normalize_name(F.col("donor_name")).alias("nm"), F.lower(F.trim("city")).alias("ci"), F.upper(F.trim("state")).alias("st"), F.nullif(text.zip5(F.col("zip")), F.lit("")).alias("zp"))
    tiers = [("name_state_zip", ["nm", "st", "zp"], 0.95), ("name_city_state", ["nm", "st", "ci"], 0.80), ("name_state", ["nm", "st"], 0.70)]
    found = matching.tiered_match(left, right, tiers, "federal_key", "donor_key", [F.desc("local_total"), F.col("donor_key")])
    return found.join(left.select("federal_key", "federal_name", "federal_total"), "federal_key")


_FL = """f AS (SELECT federal_key, federal_name, federal_total, lower(federal_name) AS nm, lower(city) AS ci, state AS st, substr(zip, 1, 5) AS zp FROM federal_donors), d AS (SELECT donor_key, donor_name, total_amount AS local_total, lower(donor_name) AS nm, lower(city) AS ci, state AS st, substr(zip, 1, 5) AS zp FROM donor_book),
u AS (SELECT f.federal_key, federal_name, federal_total, donor_key, donor_name, local_total, 0 AS rk, 'name_state_zip' AS tier, 0.95::DOUBLE AS confidence FROM f JOIN d USING (nm, st, zp) UNION ALL SELECT f.federal_key, federal_name, federal_total, donor_key, donor_name, local_total, 1, 'name_city_state', 0.80 FROM f JOIN d USING (nm, st, ci) UNION ALL SELECT f.federal_key, federal_name, federal_total, donor_key, donor_name, local_total, 2, 'name_state', 0.70 FROM f JOIN d USING (nm, st)),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY federal_key ORDER BY local_total DESC, donor_key) AS k FROM (SELECT *, min(rk) OVER (PARTITION BY federal_key) AS best FROM u) WHERE rk = best) WHERE k <= 3)"""


@query("federal_local_matches", f"WITH {_FL} SELECT federal_key, federal_name, federal_total, donor_key, donor_name, local_total, tier, confidence FROM m")
def _(t):
    return federal_local(t).select("federal_key", "federal_name", "federal_total", "donor_key", "donor_name", "local_total", "tier", "confidence")


@query("dual_system_donors", f"WITH {_FL} SELECT federal_name, donor_name, federal_total, local_total, round(federal_total + local_total, 2) AS combined, tier, confidence FROM m WHERE confidence >= 0.9 ORDER BY round(federal_total + local_total, 2) DESC, federal_key, donor_key LIMIT 25")
def _(t):
    return reports.both_systems(federal_local(t)).select("federal_name", "donor_name", "federal_total", "local_total", "combined", "tier", "confidence")


@query("federal_local_network", f"""WITH {_FL}, {EDGES}, g AS (SELECT federal_key AS src, donor_key AS dst, 'match' AS edge_type, confidence AS weight FROM m UNION ALL SELECT m.donor_key, 'committee:' || e.committee_id, 'gift', e.total_amount FROM (SELECT DISTINCT donor_key FROM m) m JOIN (SELECT split_part(donor_key, '|', 1) AS dk, committee_id, total_amount FROM e) e ON e.dk = m.donor_key)
SELECT edge_type, src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY edge_type ORDER BY weight DESC, src, dst) AS k FROM g) WHERE k <= 500""")
def _(t):
    return federal.overlap_network(federal_local(t), edges(t).withColumn("donor_key", F.split_part("donor_key", F.lit("|"), F.lit(1))), 500)


@query("receipt_gaps", f"WITH p AS (SELECT committee_id, round(sum(total_receipts), 2) AS reported FROM filings WHERE committee_id < 1000 GROUP BY 1), i AS (SELECT committee_id, round(sum(amount), 2) AS itemized FROM receipts WHERE {GOOD} GROUP BY 1) SELECT committee_id, reported, coalesce(itemized, 0) AS itemized, round(reported - coalesce(itemized, 0), 2) AS gap FROM p LEFT JOIN i USING (committee_id) WHERE abs(round(reported - coalesce(itemized, 0), 2)) >= 500 ORDER BY abs(round(reported - coalesce(itemized, 0), 2)) DESC, committee_id LIMIT 10000")
def _(t):
    reported = t.filings.where("committee_id < 1000").groupBy("committee_id").agg(F.round(F.sum("total_receipts"), 2).alias("reported"))
    return reports.receipt_gaps(reported, good(t).groupBy("committee_id").agg(F.round(F.sum("amount"), 2).alias("itemized")))


@query("officers_merged", "SELECT s_suppkey AS officer_id, s_name AS name, s_nationkey::BIGINT AS committee_id, TRUE AS is_current FROM supplier UNION ALL SELECT c_custkey, c_name, (SELECT min(committee_id) FROM links WHERE candidate_id = c_custkey), FALSE FROM customer")
def _(t):
    current = t.supplier.select(F.col("s_suppkey").alias("officer_id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("committee_id"))
    previous = t.customer.select(F.col("c_custkey").alias("officer_id"), F.col("c_name").alias("name"), F.lit(None).cast("long").alias("committee_id"))
    return reports.merge_officers(current, previous, t.links.withColumnRenamed("candidate_id", "officer_id"))


@query("candidacy_feed", "SELECT p_partkey AS candidate_id, (1990 + p_size % 9)::INT AS year, committee_id, (1990 + p_size % 9 + (p_size % 9) % 2)::INT AS cycle FROM part LEFT JOIN links ON candidate_id = p_partkey")
def _(t):
    return reports.candidacy_feed(t.part.select(F.col("p_partkey").alias("candidate_id"), (1990 + F.col("p_size") % 9).cast("int").alias("year")), t.links)
