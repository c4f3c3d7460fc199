"""Named reports and case-study packs as SQL over the civic views; one text serves Spark and the DuckDB oracle."""

from __future__ import annotations

from ledgerlens.plans.catalog import sql_query

GOOD = "amount > 0 AND NOT coalesce(archived, FALSE) AND (coalesce(trim(d2_part), '') = '' OR d2_part LIKE '1%')"

REPORTS = {
    "meta_coverage": """
SELECT 'receipts' AS name, count(*) AS row_count, cast(min(received_date) AS VARCHAR(10)) AS first_day, cast(max(received_date) AS VARCHAR(10)) AS last_day FROM receipts
UNION ALL SELECT 'expenditures', count(*), cast(min(expended_date) AS VARCHAR(10)), cast(max(expended_date) AS VARCHAR(10)) FROM expenditures
UNION ALL SELECT 'filings', count(*), cast(min(received_on) AS VARCHAR(10)), cast(max(received_on) AS VARCHAR(10)) FROM filings
UNION ALL SELECT 'committees', count(*), NULL, NULL FROM committees
UNION ALL SELECT 'candidates', count(*), NULL, NULL FROM candidates""",
    "war_chest": """
SELECT c.committee_id, c.committee_name, c.funds, s.spent, CASE WHEN s.spent > 0 THEN round(c.funds / s.spent, 6) END AS ratio
FROM committees c JOIN (SELECT committee_id, round(sum(amount), 2) AS spent FROM expenditures WHERE NOT archived GROUP BY committee_id) s ON c.committee_id = s.committee_id
WHERE c.funds > 0 ORDER BY c.funds DESC, c.committee_id LIMIT 30""",
    "top_donors_year": f"""
SELECT donor_name, round(sum(amount), 2) AS total_amount, count(*) AS n FROM receipts WHERE {GOOD} AND received_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'
GROUP BY donor_name ORDER BY total_amount DESC, donor_name LIMIT 30""",
    "top_donors_excluding": f"""
SELECT donor_name, round(sum(amount), 2) AS total_amount, count(*) AS n FROM receipts WHERE {GOOD} AND donor_name NOT ILIKE '%000001%' AND received_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'
GROUP BY donor_name ORDER BY total_amount DESC, donor_name LIMIT 30""",
    "ie_by_candidate": """
SELECT candidate_id, min(race_key) AS race_key, round(coalesce(sum(CASE WHEN supporting THEN amount END), 0), 2) AS support, round(coalesce(sum(CASE WHEN opposing THEN amount END), 0), 2) AS oppose
FROM expenditures WHERE d2_part LIKE '9%' GROUP BY candidate_id""",
    "ie_by_spender": "SELECT committee_id, round(sum(amount), 2) AS total_amount, count(DISTINCT candidate_id) AS targets FROM expenditures WHERE d2_part LIKE '9%' GROUP BY committee_id",
    "ie_support_oppose": "SELECT CASE WHEN supporting THEN 'S' WHEN opposing THEN 'O' ELSE 'U' END AS indicator, round(sum(amount), 2) AS total_amount, count(*) AS n FROM expenditures WHERE d2_part LIKE '9%' GROUP BY 1",
    "race_candidates": """
SELECT c.candidate_id, c.candidate_name, round(sum(e.amount), 2) AS total_amount FROM candidates c JOIN expenditures e ON c.candidate_id = e.candidate_id
WHERE c.race_key = 'Brand#7' GROUP BY c.candidate_id, c.candidate_name""",
    "race_office_candidates": """
SELECT c.candidate_id, c.candidate_name, round(sum(e.amount), 2) AS total_amount FROM candidates c JOIN expenditures e ON c.candidate_id = e.candidate_id
WHERE c.race_key = 'Brand#7' AND c.office = 'PROMO' GROUP BY c.candidate_id, c.candidate_name""",
    "single_committee_check": f"SELECT committee_id, count(*) AS n, round(sum(amount), 2) AS total_amount, min(received_date) AS first_day, max(received_date) AS last_day FROM receipts WHERE {GOOD} AND committee_id = 42 GROUP BY committee_id",
    "org_top_spenders": "SELECT s.committee_name, round(sum(e.amount), 2) AS total_amount FROM expenditures e JOIN committees s ON e.committee_id = s.committee_id WHERE cast(year(e.expended_date) AS INT) IN (1998, 1999) GROUP BY s.committee_name",
}

CASES = {
    "case_required_tables": "SELECT 'receipts' AS name, count(*) > 0 AS filled FROM receipts UNION ALL SELECT 'expenditures', count(*) > 0 FROM expenditures UNION ALL SELECT 'filings', count(*) > 0 FROM filings",
    "case_client_footprint": """
SELECT c.committee_id, count(DISTINCT e.payee_name) AS payees, count(DISTINCT l.candidate_id) AS candidates FROM committees c
LEFT JOIN (SELECT DISTINCT committee_id, payee_name FROM expenditures) e ON c.committee_id = e.committee_id LEFT JOIN links l ON c.committee_id = l.committee_id GROUP BY c.committee_id""",
    "case_entity_list": "SELECT DISTINCT c.committee_id, k.candidate_name FROM committees c JOIN links l ON c.committee_id = l.committee_id JOIN candidates k ON l.candidate_id = k.candidate_id WHERE c.nation_id = 4",
    "case_domain_rollup": f"""
WITH a AS (SELECT count(*) AS n, round(sum(amount), 2) AS s FROM receipts WHERE {GOOD}), b AS (SELECT count(*) AS n, round(sum(amount), 2) AS s FROM expenditures), c AS (SELECT count(*) AS n FROM filings)
SELECT a.n AS receipts, a.s AS receipt_amount, b.n AS payments, b.s AS payment_amount, c.n AS filings FROM a CROSS JOIN b CROSS JOIN c""",
    "case_trend_fanout": """
SELECT cast(year(e.expended_date) AS INT) AS year, count(*) AS pair_rows, count(DISTINCT e.payee_name) AS payees, count(DISTINCT l.candidate_id) AS linked FROM expenditures e
LEFT JOIN links l ON e.committee_id = l.committee_id AND e.candidate_id = l.candidate_id GROUP BY 1""",
    "case_full_outer_years": """
WITH raw AS (SELECT cast(year(o_orderdate) AS INT) AS y, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1), d AS (
SELECT y, count(*) AS n FROM (SELECT cast(year(o_orderdate) AS INT) + 2 AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) x WHERE k = 1 GROUP BY y)
SELECT coalesce(raw.y, d.y) AS year, raw.n AS raw_rows, d.n AS dedup_rows FROM raw FULL OUTER JOIN d ON raw.y = d.y""",
    "case_payment_trend": "SELECT cast(year(expended_date) AS INT) AS year, count(*) AS n, round(sum(amount), 2) AS total_amount FROM expenditures GROUP BY 1",
    "case_reverse_pairs": """
WITH p AS (SELECT DISTINCT committee_id AS a, donor_id % 100 AS b FROM receipts)
SELECT count(*) AS pairs, round(sum(CASE WHEN q.a IS NOT NULL THEN 1 ELSE 0 END) / count(*), 6) AS reverse_share FROM p LEFT JOIN p q ON q.a = p.b AND q.b = p.a""",
    "case_network_structure": "SELECT count(DISTINCT concat(cast(committee_id AS VARCHAR(20)), '|', payee_name)) AS pairs, count(DISTINCT committee_id) AS committees, count(DISTINCT payee_name) AS payees FROM expenditures",
    "case_bridge_overlap": f"""
WITH r AS (SELECT state, count(DISTINCT donor_key) AS donors FROM receipts WHERE {GOOD} GROUP BY state), s AS (SELECT n_name, count(DISTINCT s_suppkey) AS payees FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name),
c AS (SELECT n_name, count(DISTINCT c_custkey) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
SELECT n.n_name AS state, coalesce(r.donors, 0) AS donors, coalesce(s.payees, 0) AS payees, coalesce(c.customers, 0) AS customers FROM nation n LEFT JOIN r ON r.state = n.n_name LEFT JOIN s ON s.n_name = n.n_name LEFT JOIN c ON c.n_name = n.n_name""",
    "case_method_distribution": "SELECT coalesce(d2_part, 'none') AS method, count(*) AS n FROM expenditures GROUP BY 1",
    "case_best_row": "SELECT payee_name, candidate_id, amount FROM (SELECT payee_name, candidate_id, amount, row_number() OVER (PARTITION BY payee_name ORDER BY amount DESC, candidate_id, filing_id) AS k FROM expenditures) x WHERE k = 1",
    "case_top_agencies": """
SELECT race_key, count(*) AS n, round(sum(amount), 2) AS total_amount FROM (
SELECT race_key, amount, row_number() OVER (PARTITION BY coalesce(race_key, ''), coalesce(payee_name, ''), committee_id, expended_date ORDER BY amount DESC) AS k FROM expenditures) x
WHERE k = 1 GROUP BY race_key ORDER BY total_amount DESC NULLS LAST, race_key LIMIT 15""",
    "case_scrape_runs": "SELECT filing_id, doc_type, received_on FROM filings ORDER BY filing_id DESC LIMIT 15",
    "case_peer_ranks": f"""
WITH m AS (SELECT committee_id, round(sum(amount), 2) AS money, count(DISTINCT donor_key) AS donors FROM receipts WHERE {GOOD} GROUP BY committee_id)
SELECT committee_id, money, donors, cast(row_number() OVER (ORDER BY money DESC, committee_id) AS INT) AS money_rank, round(cume_dist() OVER (ORDER BY money), 4) AS money_pct, count(*) OVER () AS peers FROM m""",
    "case_peer_trend": f"""
WITH y AS (SELECT DISTINCT cast(year(received_date) AS INT) AS year FROM receipts WHERE received_date IS NOT NULL UNION SELECT DISTINCT cast(year(expended_date) AS INT) FROM expenditures),
k AS (SELECT committee_id FROM committees WHERE nation_id < 6), r AS (SELECT committee_id, cast(year(received_date) AS INT) AS year, round(sum(amount), 2) AS received FROM receipts WHERE {GOOD} GROUP BY 1, 2)
SELECT k.committee_id, y.year, coalesce(r.received, 0) AS received FROM y CROSS JOIN k LEFT JOIN r ON r.committee_id = k.committee_id AND r.year = y.year""",
    "case_deltas": f"""
SELECT committee_id, round(coalesce(sum(CASE WHEN year(received_date) = 1996 THEN amount END), 0), 2) AS y1996, round(coalesce(sum(CASE WHEN year(received_date) = 2000 THEN amount END), 0), 2) AS y2000,
round(round(coalesce(sum(CASE WHEN year(received_date) = 2000 THEN amount END), 0), 2) - round(coalesce(sum(CASE WHEN year(received_date) = 1996 THEN amount END), 0), 2), 2) AS delta FROM receipts WHERE {GOOD} GROUP BY committee_id""",
    "case_comparability": "SELECT race_key, count(DISTINCT payee_name) FILTER (WHERE supporting) AS supported, count(DISTINCT payee_name) FILTER (WHERE opposing) AS opposed FROM expenditures GROUP BY race_key",
    "case_peer_results": "SELECT v.name, c.c_custkey, c.c_acctbal FROM (SELECT * FROM (VALUES ('HOUSEHOLD'), ('BUILDING'), ('NOBODY')) AS w(name)) v LEFT JOIN customer c ON c.c_mktsegment = v.name AND c.c_acctbal > 9500",
    "semi_exists": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    "anti_not_exists": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    "lateral_topk": "SELECT committee_id, donor_key, total_amount, cast(k AS INT) AS rank FROM (SELECT committee_id, donor_key, total_amount, row_number() OVER (PARTITION BY committee_id ORDER BY total_amount DESC, donor_key) AS k FROM (SELECT committee_id, donor_key, round(sum(amount), 2) AS total_amount FROM receipts GROUP BY committee_id, donor_key) a) b WHERE k <= 3",
    "live_feed": "SELECT filing_id, committee_id, donor_key, amount, received_date FROM receipts WHERE received_date IS NOT NULL ORDER BY received_date DESC, amount DESC, filing_id, committee_id, donor_key LIMIT 100",
    "set_operations": "SELECT donor_key FROM receipts WHERE committee_id = 1 INTERSECT SELECT donor_key FROM receipts WHERE committee_id = 2",
    "bool_aggregates": "SELECT committee_id, bool_and(amount > 1000) AS all_large, bool_or(archived) AS any_archived FROM receipts GROUP BY committee_id",
    "json_props": "SELECT event_type, count(*) AS n FROM events WHERE value > 5 GROUP BY event_type",
}

for _name, _sql in {**REPORTS, **CASES}.items():
    sql_query(_name, _sql)

sql_query(
    "case_top_contracts",
    """
WITH d AS (SELECT payee_name, race_key, committee_id, d2_part, amount FROM (SELECT *, row_number() OVER (PARTITION BY payee_name, race_key, committee_id, d2_part ORDER BY amount DESC) AS k FROM expenditures) x WHERE k = 1),
a AS (SELECT payee_name, race_key, committee_id, d2_part, array_join(array_sort(collect_set(cast(candidate_id AS STRING))), ',') AS aliases FROM expenditures GROUP BY payee_name, race_key, committee_id, d2_part)
SELECT d.payee_name, d.race_key, d.committee_id, d.d2_part, d.amount, a.aliases FROM d JOIN a ON d.payee_name <=> a.payee_name AND d.race_key <=> a.race_key AND d.committee_id <=> a.committee_id AND d.d2_part <=> a.d2_part
ORDER BY d.amount DESC, d.payee_name, d.race_key, d.committee_id, d.d2_part LIMIT 20""",
    """
WITH d AS (SELECT payee_name, race_key, committee_id, d2_part, amount FROM (SELECT *, row_number() OVER (PARTITION BY payee_name, race_key, committee_id, d2_part ORDER BY amount DESC) AS k FROM expenditures) x WHERE k = 1),
a AS (SELECT payee_name, race_key, committee_id, d2_part, string_agg(DISTINCT candidate_id::VARCHAR, ',' ORDER BY candidate_id::VARCHAR) AS aliases FROM expenditures GROUP BY payee_name, race_key, committee_id, d2_part)
SELECT d.payee_name, d.race_key, d.committee_id, d.d2_part, d.amount, a.aliases FROM d JOIN a ON d.payee_name IS NOT DISTINCT FROM a.payee_name AND d.race_key IS NOT DISTINCT FROM a.race_key AND d.committee_id IS NOT DISTINCT FROM a.committee_id AND d.d2_part IS NOT DISTINCT FROM a.d2_part
ORDER BY d.amount DESC, d.payee_name, d.race_key, d.committee_id, d.d2_part LIMIT 20""",
)
