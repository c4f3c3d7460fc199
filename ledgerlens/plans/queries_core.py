"""Rollups, concentration, anomalies, trends, geography, filings and races over the civic views."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ledgerlens.functions.predicates import Scope, all_receipts, contributions, current_native, entity_receipts, vendor_rows
from ledgerlens.functions.text import spending_category
from ledgerlens.operators import anomalies, concentration, filings, geography, races, rollups, trends
from ledgerlens.plans.catalog import Tables, query
from ledgerlens.sources.civic import stored

#: The shared receipt predicate in SQL.
GOOD = "amount > 0 AND NOT coalesce(archived, FALSE) AND (coalesce(trim(d2_part), '') = '' OR d2_part LIKE '1%')"
EDGES = f"e AS (SELECT donor_key, committee_id, max(donor_name) AS donor_name, round(sum(amount), 2) AS total_amount, count(*) AS contribution_count, min(received_date) AS first_date, max(received_date) AS last_date FROM receipts WHERE {GOOD} AND trim(donor_key) <> '' GROUP BY ALL)"
MONTHS = f"m AS (SELECT committee_id, strftime(received_date, '%Y-%m') AS month, round(sum(amount), 2) AS total_amount, count(*) AS contribution_count FROM receipts WHERE {GOOD} AND received_date IS NOT NULL GROUP BY ALL)"


def good(t: Tables):
    return t.receipts.where(contributions())


def edges(t: Tables):
    """Donor-committee rollup, stored once as the refresh job does."""
    return stored(t.spark, t.sf_dir, "receipts", "edges", lambda: rollups.donor_committee(good(t)))


@query("donor_committee_agg", f"WITH {EDGES} SELECT * FROM e")
def _(t):
    return rollups.donor_committee(good(t))


@query("donor_summary", f"WITH {EDGES} SELECT donor_key, max(donor_name) AS donor_name, round(sum(total_amount), 2) AS total_amount, sum(contribution_count)::BIGINT AS contribution_count, count(*) AS committee_count, min(first_date) AS first_date, max(last_date) AS last_date FROM e GROUP BY donor_key")
def _(t):
    return rollups.donor_summary(edges(t))


@query("donor_cycle_summary", f"SELECT (year(received_date) + year(received_date) % 2)::INT AS cycle, donor_key, max(donor_name) AS donor_name, round(sum(amount), 2) AS total_amount, count(*) AS contribution_count, count(DISTINCT committee_id) AS committee_count FROM receipts WHERE {GOOD} AND received_date IS NOT NULL AND trim(donor_key) <> '' GROUP BY ALL")
def _(t):
    return rollups.donor_cycle_summary(good(t))


@query("monthly_totals", f"WITH {MONTHS} SELECT * FROM m")
def _(t):
    return rollups.monthly_totals(good(t), ("committee_id",))


P95 = f"p AS (SELECT amount AS p95 FROM (SELECT amount, row_number() OVER (ORDER BY amount) AS r, count(*) OVER () AS n FROM receipts WHERE {GOOD}) WHERE r = floor((n - 1) * 0.95)::BIGINT + 1)"


@query("percentile_floor_rank", f"SELECT amount AS value, n FROM (SELECT amount, row_number() OVER (ORDER BY amount) AS r, count(*) OVER () AS n FROM receipts WHERE {GOOD}) WHERE r = floor((n - 1) * 0.95)::BIGINT + 1")
def _(t):
    return rollups.floor_rank(good(t), "amount", 0.95)


@query("percentile_markers", " UNION ALL ".join(f"SELECT '{name}' AS marker, amount AS value FROM (SELECT amount, row_number() OVER (ORDER BY amount) AS r, count(*) OVER () AS n FROM receipts WHERE {GOOD}) WHERE r = floor((n - 1) * {p})::BIGINT + 1" for name, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))))
def _(t):
    return rollups.floor_ranks(good(t), "amount", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


@query("percentile_interpolated", "SELECT committee_id, round(quantile_cont(amount, 0.95), 4) AS value, count(amount) AS n FROM receipts WHERE amount > 0 AND NOT coalesce(archived, FALSE) AND d2_part LIKE '1%' GROUP BY committee_id")
def _(t):
    return rollups.interpolated(t.receipts.where(entity_receipts()), "amount", 0.95, ("committee_id",)).withColumn("value", F.round("value", 4))


@query("large_contributions", f"WITH {P95} SELECT filing_id, committee_id, donor_key, amount, received_date, greatest(5000.0::DOUBLE, 2.0::DOUBLE * p95) AS threshold FROM receipts, p WHERE {GOOD} AND amount >= greatest(5000.0::DOUBLE, 2.0::DOUBLE * p95)")
def _(t):
    return rollups.large_contributions(good(t)).select("filing_id", "committee_id", "donor_key", "amount", "received_date", "threshold")


@query("large_contributions_low", f"WITH {P95} SELECT filing_id, committee_id, donor_key, amount, greatest(5000.0::DOUBLE, 1.0::DOUBLE * p95) AS threshold FROM receipts, p WHERE {GOOD} AND amount >= greatest(5000.0::DOUBLE, 1.0::DOUBLE * p95)")
def _(t):
    return rollups.large_contributions(good(t), factor=1.0).select("filing_id", "committee_id", "donor_key", "amount", "threshold")


@query("payee_rollup", "SELECT committee_id, lower(trim(payee_name)) AS payee_key, min(payee_name) AS payee_name, round(sum(amount), 2) AS total_amount, count(*) AS payment_count, min(expended_date) AS first_date, max(expended_date) AS last_date FROM expenditures WHERE NOT archived AND (d2_part IS NULL OR d2_part NOT LIKE '9%') GROUP BY committee_id, lower(trim(payee_name))")
def _(t):
    return rollups.payee_rollup(t.expenditures.where(current_native() & vendor_rows()))


@query("recipient_mode_rollup", "SELECT lower(trim(payee_name)) AS recipient_key, mode() WITHIN GROUP (ORDER BY payee_name) AS recipient_name, round(sum(amount), 2) AS total_amount, count(*) AS payment_count, count(DISTINCT committee_id) AS committee_count FROM expenditures WHERE NOT archived GROUP BY 1")
def _(t):
    return rollups.recipient_summary(t.expenditures.where(current_native()))


@query("part_sums", "SELECT committee_id, " + ", ".join(f"round(coalesce(sum(amount) FILTER (WHERE substr(d2_part, 1, 1) = '{p}'), 0), 2) AS part_{p}_sum" for p in "6789") + ", round(coalesce(sum(amount) FILTER (WHERE coalesce(substr(d2_part, 1, 1), '') NOT IN ('6', '7', '8', '9')), 0), 2) AS other_sum, count(*) AS row_count FROM expenditures GROUP BY committee_id")
def _(t):
    return rollups.part_sums(t.expenditures, ("committee_id",), ("6", "7", "8", "9"))


@query("finance_agg_by_cycle", "SELECT committee_id, (year(period_end) + year(period_end) % 2)::INT AS cycle, count(DISTINCT filing_id) FILTER (WHERE NOT archived) AS filing_count, round(coalesce(sum(total_receipts) FILTER (WHERE NOT archived), 0), 2) AS sum_receipts, max(total_receipts) FILTER (WHERE NOT archived) AS max_receipts, count(*) FILTER (WHERE archived) AS archived_count FROM filings GROUP BY ALL")
def _(t):
    return filings.finance_by_cycle(t.filings)


CONC = f"""WITH {EDGES}, s AS (SELECT *, sum(total_amount) OVER w AS tot, row_number() OVER (PARTITION BY committee_id ORDER BY total_amount DESC, donor_key) AS dn,
 row_number() OVER (PARTITION BY committee_id ORDER BY total_amount, donor_key DESC) AS up FROM e WHERE total_amount > 0 WINDOW w AS (PARTITION BY committee_id)),
 c AS (SELECT committee_id, round(sum(total_amount), 2) AS total_amount, count(*) AS donor_count, round(sum((total_amount / tot) * (total_amount / tot)) * 10000, 2) AS hhi,
 round(2 * sum(up * total_amount) / (count(*) * sum(total_amount)) - (count(*) + 1) / count(*), 4) AS gini,
 round(sum(total_amount / tot) FILTER (WHERE dn <= 1), 4) AS top1_share, round(sum(total_amount / tot) FILTER (WHERE dn <= 5), 4) AS top5_share, round(sum(total_amount / tot) FILTER (WHERE dn <= 10), 4) AS top10_share FROM s GROUP BY committee_id)"""


@query("donor_concentration", CONC + " SELECT * FROM c")
def _(t):
    return concentration.concentration(edges(t))


@query("donor_provenance", f"WITH {EDGES}, s AS (SELECT *, round(sum(total_amount) OVER (PARTITION BY committee_id), 2) AS group_total, row_number() OVER (PARTITION BY committee_id ORDER BY total_amount DESC, donor_name, donor_key) AS rank FROM e WHERE total_amount > 0) SELECT committee_id, rank::INT AS rank, donor_key, donor_name, total_amount, round(total_amount / group_total, 4) AS share, group_total, round(group_total - sum(total_amount) OVER (PARTITION BY committee_id), 2) AS unattributed FROM s WHERE rank <= 5")
def _(t):
    return concentration.provenance(edges(t))


@query("state_hhi", f"WITH s AS (SELECT committee_id, state, sum(amount) AS s FROM receipts WHERE {GOOD} GROUP BY ALL), h AS (SELECT committee_id, s / sum(s) OVER (PARTITION BY committee_id) AS share FROM s WHERE s > 0) SELECT committee_id, round(sum(share * share) * 10000, 2) AS hhi, count(*) AS parts, round(max(share), 4) AS top_share FROM h GROUP BY committee_id")
def _(t):
    return concentration.hhi_over(good(t), "committee_id", "state", "amount")


SPIKE = "SELECT committee_id, month, total_amount, round(b, 2) AS baseline, round(total_amount / b, 2) AS ratio FROM (SELECT *, count(*) OVER (PARTITION BY committee_id) AS n, count(*) OVER w AS k, avg(total_amount) OVER w AS b FROM m WINDOW w AS (PARTITION BY committee_id ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) WHERE n >= 4 AND k = 3 AND b > 0 AND total_amount >= 3.0::DOUBLE * b AND total_amount - b >= 2000"


@query("monthly_spike_present_rows", f"WITH {MONTHS} {SPIKE}")
def _(t):
    return anomalies.spikes_present(good(t))


@query("monthly_spike_zero_filled", f"WITH {MONTHS}, r AS (SELECT committee_id, min(strptime(month || '-01', '%Y-%m-%d')) AS a, max(strptime(month || '-01', '%Y-%m-%d')) AS b FROM m GROUP BY 1), g AS (SELECT committee_id, strftime(unnest(generate_series(a, b, INTERVAL 1 MONTH)), '%Y-%m') AS month FROM r), z AS (SELECT g.committee_id, g.month, coalesce(m.total_amount, 0) AS total_amount FROM g LEFT JOIN m USING (committee_id, month)), w AS (SELECT *, round(avg(total_amount) OVER (PARTITION BY committee_id ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 2) AS baseline FROM z) SELECT committee_id, month, total_amount, baseline, round(total_amount / baseline, 2) AS ratio FROM w WHERE baseline > 0 AND round(total_amount / baseline, 2) >= 3 AND round(total_amount - baseline, 2) >= 2000")
def _(t):
    return anomalies.spikes_zero_filled(good(t))


@query("concentration_flags", CONC + " SELECT committee_id, hhi, donor_count, round(hhi / 2500, 2) AS severity FROM c WHERE hhi >= 20 AND donor_count >= 3")
def _(t):
    return anomalies.concentration_flags(good(t), hhi=20.0)


@query("anomaly_union", CONC.replace("WITH ", f"WITH {MONTHS}, {P95}, ") + f" SELECT 'large_single' AS rule, committee_id, strftime(received_date, '%Y-%m') AS month, amount AS observed, greatest(5000.0::DOUBLE, 2.0::DOUBLE * p95) AS baseline, round(amount / greatest(5000.0::DOUBLE, 2.0::DOUBLE * p95), 2) AS severity FROM receipts, p WHERE {GOOD} AND amount >= greatest(5000.0::DOUBLE, 2.0::DOUBLE * p95) UNION ALL SELECT 'monthly_spike', committee_id, month, total_amount, baseline, ratio FROM ({SPIKE}) UNION ALL SELECT 'high_concentration', committee_id, NULL, hhi, 2500.0::DOUBLE, round(hhi / 2500, 2) FROM c WHERE hhi >= 20 AND donor_count >= 3")
def _(t):
    return anomalies.anomaly_union(good(t), hhi=20.0)


ALLMONTHS = f"m AS (SELECT strftime(received_date, '%Y-%m') AS month, round(sum(amount), 2) AS total_amount, count(*) AS contribution_count FROM receipts WHERE {GOOD} AND received_date IS NOT NULL GROUP BY ALL)"


@query("time_series_ma3_mom", f"WITH {ALLMONTHS}, k AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY month DESC) AS n FROM m) WHERE n <= 24) SELECT month, total_amount, contribution_count, round(avg(total_amount) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS ma3, round((total_amount - lag(total_amount) OVER (ORDER BY month)) / nullif(lag(total_amount) OVER (ORDER BY month), 0) * 100, 2) AS mom_pct FROM k")
def _(t):
    return trends.time_series(rollups.monthly_totals(good(t)))


@query("cumulative_inflow", f"WITH {MONTHS} SELECT *, round(sum(total_amount) OVER (PARTITION BY committee_id ORDER BY month ROWS UNBOUNDED PRECEDING), 2) AS running_total FROM m")
def _(t):
    return trends.cumulative(rollups.monthly_totals(good(t), ("committee_id",)), "committee_id")


@query("size_bands_by_year", f"SELECT year(received_date)::INT AS year, CASE WHEN amount < 200 THEN 'under_200' WHEN amount < 1000 THEN '200_to_999' WHEN amount < 5000 THEN '1000_to_4999' ELSE '5000_up' END AS band, round(sum(amount), 2) AS total_amount, count(*) AS n FROM receipts WHERE {GOOD} AND received_date IS NOT NULL GROUP BY ALL")
def _(t):
    return trends.size_bands_by_year(good(t))


@query("cycle_totals_null_kept", "SELECT committee_id, (year(received_date) + year(received_date) % 2)::INT AS cycle, round(sum(amount), 2) AS total_amount, count(*) AS n FROM receipts WHERE amount > 0 AND NOT coalesce(archived, FALSE) GROUP BY ALL")
def _(t):
    return trends.cycle_totals(t.receipts.where(all_receipts()), ("committee_id",))


@query("scope_window", f"SELECT committee_id, round(sum(amount), 2) AS total_amount, count(*) AS n FROM receipts WHERE {GOOD} AND received_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY 1")
def _(t):
    rows = good(t).where(Scope.of_cycle(1997).where("received_date"))
    return rows.groupBy("committee_id").agg(F.round(F.sum("amount"), 2).alias("total_amount"), F.count("*").alias("n"))


@query("geo_states", f"SELECT state, round(sum(amount), 2) AS total_amount, count(*) AS n, count(DISTINCT donor_key) AS donor_count FROM receipts WHERE {GOOD} GROUP BY 1")
def _(t):
    return geography.by_place(good(t), ("state",))


@query("geo_cities", f"SELECT city || ', ' || upper(state) AS city_key, round(sum(amount), 2) AS total_amount, count(*) AS n, count(DISTINCT donor_key) AS donor_count FROM receipts WHERE {GOOD} GROUP BY 1")
def _(t):
    return geography.cities(good(t))


@query("geo_drilldown_page", f"WITH d AS (SELECT donor_key, max(donor_name) AS donor_name, round(sum(amount), 2) AS total_amount, count(*) AS n FROM receipts WHERE {GOOD} AND state = 'NATION_3' GROUP BY 1) SELECT *, (SELECT count(*) FROM d) AS total_rows, greatest(1, ceil((SELECT count(*) FROM d) / 25))::BIGINT AS total_pages, (SELECT round(sum(amount), 2) FROM receipts WHERE {GOOD} AND state = 'NATION_3') AS cell_total FROM d ORDER BY total_amount DESC, donor_key LIMIT 25")
def _(t):
    return geography.drilldown(good(t), "NATION_3")


@query("region_vote", f"SELECT committee_id, region, total_amount FROM (SELECT *, row_number() OVER (PARTITION BY committee_id ORDER BY total_amount DESC, region) AS n FROM (SELECT committee_id, region, round(sum(amount), 2) AS total_amount FROM receipts WHERE {GOOD} GROUP BY ALL)) WHERE n = 1")
def _(t):
    return geography.region_vote(good(t))


@query("state_shares_unknown", f"WITH s AS (SELECT CASE WHEN state IN ('NATION_1', 'NATION_2', 'NATION_3') THEN state END AS state, round(sum(amount), 2) AS total_amount FROM receipts WHERE {GOOD} GROUP BY 1) SELECT coalesce(state, 'unknown') AS state, total_amount, round(total_amount / sum(total_amount) OVER (), 4) AS share FROM s")
def _(t):
    return geography.state_shares(good(t), ["NATION_1", "NATION_2", "NATION_3"])


@query("spending_categories", """SELECT category, round(sum(amount), 2) AS total_amount, count(*) AS n, round(avg(amount), 2) AS mean_amount, min(purpose) AS sample FROM (SELECT amount, purpose, CASE
WHEN regexp_matches(lower(purpose), 'advertis|media|digital|facebook|google|youtube|radio|television|tv|mail|billboard') THEN 'media_advertising'
WHEN regexp_matches(lower(purpose), 'consult|strateg|advis|poll|research|analytics|data|professional service') THEN 'consulting_professional'
WHEN regexp_matches(lower(purpose), 'legal|attorney|law|compliance|filing|accounting|audit|treasurer') THEN 'legal_compliance'
WHEN regexp_matches(lower(purpose), 'travel|hotel|flight|airfare|uber|lyft|mileage|event|venue|catering') THEN 'travel_events'
WHEN regexp_matches(lower(purpose), 'salary|payroll|wage|stipend|staff|contract labor|compensation') THEN 'payroll_staff'
WHEN regexp_matches(lower(purpose), 'fundrais(?:ing|er)|donation platform|ticket|actblue') THEN 'fundraising'
WHEN regexp_matches(lower(purpose), 'print|postage|brochure|flyer') THEN 'printing_postage'
WHEN regexp_matches(lower(purpose), 'rent|office|supplies|phone|internet|utilities|software|license|subscription') THEN 'office_admin'
ELSE 'uncategorized' END AS category FROM expenditures WHERE NOT archived) GROUP BY 1""")
def _(t):
    rows = t.expenditures.where(current_native()).withColumn("category", spending_category(F.col("purpose")))
    return rows.groupBy("category").agg(F.round(F.sum("amount"), 2).alias("total_amount"), F.count("*").alias("n"), F.round(F.avg("amount"), 2).alias("mean_amount"), F.min("purpose").alias("sample"))


LIVE = "lv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY committee_id, period_end ORDER BY (d2_id IS NOT NULL) DESC, received_on DESC NULLS LAST, filing_id DESC) AS rn FROM filings) WHERE rn = 1)"
RECENT = "mr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY committee_id ORDER BY period_end DESC NULLS LAST, (d2_id IS NOT NULL) DESC, received_on DESC NULLS LAST, filing_id DESC) AS rn FROM filings) WHERE rn = 1)"


@query("live_filings", f"WITH {LIVE} SELECT committee_id, period_end, filing_id, received_on, d2_id FROM lv")
def _(t):
    return filings.live_filings(t.filings).select("committee_id", "period_end", "filing_id", "received_on", "d2_id")


@query("most_recent_filing", f"WITH {RECENT} SELECT committee_id, period_end, filing_id, received_on, d2_id FROM mr")
def _(t):
    return filings.most_recent_filing(t.filings).select("committee_id", "period_end", "filing_id", "received_on", "d2_id")


def _filer_rows(t):
    """Receipts by the filer of their filing."""
    return t.receipts.drop("committee_id").join(t.filings.select("filing_id", "committee_id"), "filing_id").select("filing_id", "committee_id", "donor_key", "amount", "received_date")


FILER = "fr AS (SELECT r.filing_id, f.committee_id, r.donor_key, r.amount, r.received_date FROM receipts r JOIN filings f ON r.filing_id = f.filing_id)"


@query("condensed_receipts", f"WITH {FILER}, {LIVE}, {RECENT} SELECT fr.* FROM fr LEFT JOIN mr ON fr.committee_id = mr.committee_id WHERE mr.committee_id IS NULL OR received_date > mr.period_end UNION SELECT * FROM fr WHERE filing_id IN (SELECT filing_id FROM lv)")
def _(t):
    return filings.condense(_filer_rows(t), filings.most_recent_filing(t.filings), filings.live_filings(t.filings), "received_date", True)


@query("condensed_expenditures", f"WITH {FILER}, {LIVE}, {RECENT} SELECT fr.* FROM fr JOIN mr ON fr.committee_id = mr.committee_id WHERE received_date > mr.period_end UNION SELECT * FROM fr WHERE filing_id IN (SELECT filing_id FROM lv)")
def _(t):
    return filings.condense(_filer_rows(t), filings.most_recent_filing(t.filings), filings.live_filings(t.filings), "received_date", False)


RECON = "rc AS (SELECT f.filing_id, f.committee_id, f.total_receipts AS reported, coalesce(i.n, 0) AS row_count, round(coalesce(i.s, 0), 2) AS itemized, i.a AS first_date, i.b AS last_date, round(round(coalesce(i.s, 0), 2) - f.total_receipts, 2) AS difference FROM filings f LEFT JOIN (SELECT filing_id, count(*) AS n, sum(amount) AS s, min(received_date) AS a, max(received_date) AS b FROM receipts GROUP BY 1) i ON f.filing_id = i.filing_id)"


@query("filing_recon_receipts", f"WITH {RECON} SELECT * FROM rc")
def _(t):
    return filings.reconcile(t.filings, t.receipts)


@query("mismatch_status", f"WITH {RECON} SELECT filing_id, CASE WHEN reported = 0 AND itemized = 0 THEN 'empty' WHEN itemized = 0 THEN 'no_itemized' WHEN reported = 0 THEN 'no_reported' WHEN abs(itemized - reported) <= 0.05::DOUBLE * reported THEN 'match' ELSE 'mismatch' END AS status, CASE WHEN reported > 0 THEN round(itemized / reported, 4) END AS ratio FROM rc")
def _(t):
    return filings.mismatch_status(filings.reconcile(t.filings, t.receipts)).select("filing_id", "status", "ratio")


@query("recon_outliers", f"WITH {RECON} SELECT * FROM rc WHERE abs(difference) >= 1000 ORDER BY abs(difference) DESC, filing_id LIMIT 50")
def _(t):
    return filings.recon_outliers(filings.reconcile(t.filings, t.receipts))


@query("filing_recon_parts", "SELECT filing_id, " + ", ".join(f"round(coalesce(sum(amount) FILTER (WHERE substr(d2_part, 1, 1) = '{p}'), 0), 2) AS part_{p}_sum" for p in "6789") + ", round(coalesce(sum(amount) FILTER (WHERE coalesce(substr(d2_part, 1, 1), '') NOT IN ('6', '7', '8', '9')), 0), 2) AS other_sum, count(*) AS row_count, count(*) FILTER (WHERE supporting AND opposing OR d2_part IS NULL) AS anomalies FROM expenditures GROUP BY filing_id")
def _(t):
    odd = t.expenditures.groupBy("filing_id").agg(F.sum(F.when((F.col("supporting") & F.col("opposing")) | F.col("d2_part").isNull(), 1).otherwise(0)).alias("anomalies"))
    return rollups.part_sums(t.expenditures, ("filing_id",), ("6", "7", "8", "9")).join(odd, "filing_id")


@query("committee_money", f"WITH {RECENT} SELECT c.committee_id, round(c.funds + coalesce(s.x, 0), 2) AS money FROM committees c LEFT JOIN (SELECT r.committee_id, sum(amount) AS x FROM receipts r LEFT JOIN mr ON r.committee_id = mr.committee_id WHERE mr.committee_id IS NULL OR r.received_date > mr.period_end GROUP BY 1) s ON c.committee_id = s.committee_id")
def _(t):
    return filings.committee_money(filings.most_recent_filing(t.filings), t.receipts, t.committees)


@query("upsert_latest", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, isnew DESC, o_orderkey) AS n FROM (SELECT *, 0 AS isnew FROM orders WHERE year(o_orderdate) < 1999 UNION ALL SELECT *, 1 FROM orders WHERE year(o_orderdate) >= 1999)) WHERE n = 1")
def _(t):
    first = filings.pick_first(t.orders, ["o_custkey", "o_orderdate"], [F.col("o_orderkey")])
    old, new = first.where(F.year("o_orderdate") < 1999), first.where(F.year("o_orderdate") >= 1999)
    return filings.upsert(old, new, ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderkey", "o_totalprice")


TOTALS = f"ct AS (SELECT committee_id, round(sum(amount), 2) AS total_amount FROM receipts WHERE {GOOD} GROUP BY 1)"


def committee_totals(t):
    return good(t).groupBy("committee_id").agg(F.round(F.sum("amount"), 2).alias("total_amount"))


@query("race_builder", f"WITH {TOTALS}, o AS (SELECT l.committee_id, l.candidate_id, ct.total_amount AS s FROM links l JOIN ct USING (committee_id)), q AS (SELECT *, max(s) OVER (PARTITION BY committee_id) / count(*) OVER (PARTITION BY committee_id) AS part FROM o), k AS (SELECT candidate_id, sum(part) AS money FROM q GROUP BY 1), x AS (SELECT candidate_id, sum(amount) AS outside FROM expenditures WHERE d2_part LIKE '9%' GROUP BY 1) SELECT race_key, count(*) AS candidate_count, round(sum(coalesce(money, 0)), 2) AS money, round(sum(coalesce(outside, 0)), 2) AS outside, round(max(coalesce(money, 0)) / sum(coalesce(money, 0)), 4) AS top_candidate_share, round(sum(coalesce(outside, 0)) / sum(coalesce(money, 0)), 4) AS pressure FROM candidates LEFT JOIN k USING (candidate_id) LEFT JOIN x USING (candidate_id) GROUP BY 1")
def _(t):
    return races.race_builder(t.candidates, t.links, committee_totals(t), t.expenditures.where("d2_part LIKE '9%'"))


@query("outside_by_candidate", "SELECT candidate_id, round(coalesce(sum(amount) FILTER (WHERE supporting), 0), 2) AS support, round(coalesce(sum(amount) FILTER (WHERE opposing), 0), 2) AS oppose, count(DISTINCT committee_id) AS spenders FROM expenditures WHERE d2_part LIKE '9%' AND (supporting OR opposing) GROUP BY 1")
def _(t):
    return races.outside_by_candidate(t.expenditures)


@query("payee_topk_per_race", "SELECT race_key, payee_name, total_amount, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY race_key ORDER BY total_amount DESC, payee_name) AS rank FROM (SELECT race_key, payee_name, round(sum(amount), 2) AS total_amount FROM expenditures GROUP BY ALL)) WHERE rank <= 5")
def _(t):
    return races.top_per_group(t.expenditures, "race_key", "payee_name", "amount", 5)


@query("cumulative_inflow_by_top_race", "WITH k AS (SELECT race_key, round(sum(amount), 2) AS key_total FROM expenditures GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5), m AS (SELECT race_key, strftime(expended_date, '%Y-%m') AS month, round(sum(amount), 2) AS total_amount, count(*) AS contribution_count FROM expenditures WHERE race_key IN (SELECT race_key FROM k) GROUP BY ALL) SELECT *, round(sum(total_amount) OVER (PARTITION BY race_key ORDER BY month ROWS UNBOUNDED PRECEDING), 2) AS running_total FROM m")
def _(t):
    top = trends.top_keys(t.expenditures, "race_key", "amount", 5).select("race_key")
    rows = t.expenditures.join(top, "race_key", "left_semi")
    return trends.cumulative(rollups.monthly_totals(rows, ("race_key",), day="expended_date"), "race_key")


@query("fold_other", f"WITH c AS (SELECT state, round(sum(amount), 2) AS total_amount FROM receipts WHERE {GOOD} GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY total_amount DESC, state) AS n FROM c) SELECT CASE WHEN n <= 8 THEN state ELSE 'other' END AS node, round(sum(total_amount), 2) AS total_amount FROM r GROUP BY 1")
def _(t):
    return races.fold_other(good(t), "state", "amount", 8)


@query("month_overlap", f"WITH m AS (SELECT committee_id, strftime(received_date, '%Y-%m') AS month, round(sum(amount), 2) AS total_amount FROM receipts WHERE {GOOD} AND received_date IS NOT NULL GROUP BY ALL) SELECT * FROM m WHERE last_day(strptime(month || '-01', '%Y-%m-%d')) >= DATE '1998-02-10' AND strptime(month || '-01', '%Y-%m-%d') <= DATE '1998-05-03'")
def _(t):
    from ledgerlens.functions.predicates import month_overlaps

    months = rollups.monthly_totals(good(t), ("committee_id",)).drop("contribution_count")
    return months.where(month_overlaps(F.to_date(F.concat("month", F.lit("-01"))), date(1998, 2, 10), date(1998, 5, 3)))
