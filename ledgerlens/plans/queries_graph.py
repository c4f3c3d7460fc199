"""Graph and federal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import graph, kernels
from ledgerlens.plans.catalog import query
from ledgerlens.plans.queries_core import EDGES, GOOD, edges, good

#: Donor to committee edges with typed node ids.
NET = f"{EDGES}, n AS (SELECT 'donor:' || donor_key AS src, 'committee:' || committee_id AS dst, total_amount AS weight FROM e)"
BOTH = "b AS (SELECT src AS node, dst AS other, weight FROM n UNION ALL SELECT dst, src, weight FROM n)"


def network(t):
    return edges(t).select(F.concat(F.lit("donor:"), "donor_key").alias("src"), F.concat(F.lit("committee:"), F.col("committee_id").cast("string")).alias("dst"), F.col("total_amount").alias("weight"))


def small_network(t):
    """States and committees, for the driver kernels: one edge per state and committee at most."""
    rows = good(t).groupBy(F.concat(F.lit("state:"), "state").alias("src"), F.concat(F.lit("committee:"), F.col("committee_id").cast("string")).alias("dst")).agg(F.round(F.sum("amount"), 2).alias("weight"))
    return rows


@query("network_edges", f"WITH {NET} SELECT * FROM n")
def _(t):
    return network(t)


@query("degree_centrality", f"WITH {NET}, {BOTH} SELECT node, round(sum(weight), 2) AS weighted_degree, count(DISTINCT other) AS degree FROM b GROUP BY 1")
def _(t):
    return graph.degree_centrality(network(t))


@query("bridge_ratio", f"WITH {NET}, {BOTH}, l AS (SELECT DISTINCT 'donor:' || donor_key AS node, region AS label FROM receipts WHERE {GOOD} AND occupation <> 'MACHINERY' UNION ALL SELECT 'committee:' || s_suppkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), x AS (SELECT b.node, l.label, k.label AS other FROM b LEFT JOIN l ON b.node = l.node LEFT JOIN l k ON b.other = k.node) SELECT node, CASE WHEN label IS NOT NULL AND count(*) FILTER (WHERE label IS NOT NULL AND other IS NOT NULL) > 0 THEN round(count(*) FILTER (WHERE label <> other) / count(*) FILTER (WHERE label IS NOT NULL AND other IS NOT NULL), 4) END AS bridge_ratio, count(*) FILTER (WHERE label IS NOT NULL AND other IS NOT NULL) AS known_edges FROM x GROUP BY node, label")
def _(t):
    donors = good(t).where("occupation <> 'MACHINERY'").select(F.concat(F.lit("donor:"), "donor_key").alias("node"), F.col("region").alias("label")).distinct()
    committees = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    labels = donors.unionByName(committees.select(F.concat(F.lit("committee:"), F.col("s_suppkey").cast("string")).alias("node"), F.col("r_name").alias("label")))
    return graph.bridge_ratio(network(t), labels)


_HEAVY = "ORDER BY weight DESC, shared DESC, m1, m2 LIMIT"
_POOL = "SELECT {k} FROM (SELECT {k}, round(sum({a}), 2) AS s FROM {t} GROUP BY 1 ORDER BY s DESC, {k} LIMIT {n})"
_MONEY = "lk AS (SELECT DISTINCT committee_id, candidate_id FROM links WHERE candidate_id IS NOT NULL), lc AS (SELECT committee_id, count(*) AS n FROM lk GROUP BY 1)"


def _pairs(table: str, member: str, group: str, amount: str, shared: int, least: float, limit: int) -> str:
    weight = f"round(sum(least(a.{amount}, b.{amount})) + 5e-7::DOUBLE, 2)"
    return f"SELECT a.{member} AS m1, b.{member} AS m2, count(*) AS shared, {weight} AS weight FROM {table} a JOIN {table} b ON a.{group} = b.{group} AND a.{member} < b.{member} GROUP BY ALL HAVING count(*) >= {shared} AND {weight} >= {least} {_HEAVY} {limit}"


@query("cogiving_pairs", f"""WITH {EDGES}, {_MONEY}, f AS (SELECT donor_key, committee_id, total_amount FROM e WHERE donor_key IN ({_POOL.format(k='donor_key', a='total_amount', t='e', n=800)})),
g AS (SELECT donor_key, candidate_id, round(sum(total_amount / n), 6) AS amount FROM f JOIN lk USING (committee_id) JOIN lc USING (committee_id) GROUP BY ALL),
p AS ({_pairs('f', 'donor_key', 'committee_id', 'total_amount', 2, 5000, 4800)}), q AS ({_pairs('g', 'donor_key', 'candidate_id', 'amount', 2, 5000, 4800)}),
u AS (SELECT m1, m2, shared AS c, 0 AS k, weight FROM p UNION ALL SELECT m1, m2, 0, shared, weight FROM q)
SELECT m1, m2, sum(c)::BIGINT AS shared_committees, sum(k)::BIGINT AS shared_candidates, sum(c + k)::BIGINT AS shared, round(sum(weight), 2) AS weight FROM u GROUP BY ALL {_HEAVY} 1200""")
def _(t):
    return graph.cogiving(edges(t), t.links)


@query("committee_similarity", f"""WITH {EDGES}, f AS (SELECT donor_key, committee_id, total_amount FROM e WHERE donor_key IN ({_POOL.format(k='donor_key', a='total_amount', t='e', n=3000)}) AND committee_id IN ({_POOL.format(k='committee_id', a='total_amount', t='e', n=500)}))
{_pairs('f', 'committee_id', 'donor_key', 'total_amount', 3, 10000, 1200)}""")
def _(t):
    return graph.similarity(edges(t))


@query("candidate_competition", f"""WITH {EDGES}, {_MONEY}, f AS (SELECT * FROM e WHERE donor_key IN ({_POOL.format(k='donor_key', a='total_amount', t='e', n=6250)})),
g AS (SELECT donor_key, candidate_id, round(sum(total_amount / n), 6) AS amount FROM f JOIN lk USING (committee_id) JOIN lc USING (committee_id) GROUP BY ALL HAVING round(sum(total_amount / n), 6) > 0),
tc AS (SELECT candidate_id, round(sum(s / n), 6) AS amount FROM (SELECT committee_id, sum(total_amount) AS s FROM f GROUP BY 1) JOIN lk USING (committee_id) JOIN lc USING (committee_id) GROUP BY 1),
o AS (SELECT * FROM g WHERE candidate_id IN ({_POOL.format(k='candidate_id', a='amount', t='tc', n=250)})),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY donor_key ORDER BY amount DESC, candidate_id) AS n FROM o) WHERE n <= 20) {_pairs('k', 'candidate_id', 'donor_key', 'amount', 2, 2500, 1200)}""")
def _(t):
    return graph.competition(edges(t), t.links)


@query("bfs_hops", "WITH RECURSIVE q AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem), b AS (SELECT src AS node, dst AS other FROM q UNION SELECT dst, src FROM q), h(node, hop) AS (SELECT 's1', 0 UNION SELECT b.other, h.hop + 1 FROM h JOIN b ON h.node = b.node WHERE h.hop < 3) SELECT node, min(hop)::INT AS hop FROM h GROUP BY 1")
def _(t):
    rows = t.lineitem.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.lit(1.0).alias("weight"))
    start = t.spark.range(1).select(F.lit("s1").alias("node"))
    return graph.hops(rows, start, 3)


@query("money_hops")
def _(t):
    """Follow the money from committee 1 over all edges: donors to committees to linked candidates. No oracle; tested against brute force."""
    links = t.links.select(F.concat(F.lit("committee:"), F.col("committee_id").cast("string")).alias("src"), F.concat(F.lit("candidate:"), F.col("candidate_id").cast("string")).alias("dst"), F.lit(1.0).alias("weight"))
    start = t.spark.range(1).select(F.lit("committee:1").alias("node"))
    return graph.hops(network(t).unionByName(links), start, 3)


@query("components", "WITH RECURSIVE q AS (SELECT DISTINCT c_custkey * 2 AS a, c_nationkey * 2 + 1 AS b FROM customer), b AS (SELECT a AS node, b AS other FROM q UNION SELECT b, a FROM q), h(node, root) AS (SELECT node, node FROM b UNION SELECT b.other, h.root FROM h JOIN b ON h.node = b.node WHERE h.root < b.other) SELECT node, min(root) AS component FROM h GROUP BY 1")
def _(t):
    rows = t.customer.select((F.col("c_custkey") * 2).alias("src"), (F.col("c_nationkey").cast("long") * 2 + 1).alias("dst"))
    return graph.components(rows)


@query("ego_caps_other", f"WITH d AS (SELECT 'donor' AS edge_type, donor_key AS other, round(sum(amount), 2) AS weight FROM receipts WHERE {GOOD} AND committee_id = 1 GROUP BY 2), v AS (SELECT 'vendor' AS edge_type, payee_name AS other, round(sum(amount), 2) AS weight FROM expenditures WHERE committee_id = 1 AND (d2_part IS NULL OR d2_part NOT LIKE '9%') GROUP BY 2), u AS (SELECT * FROM d UNION ALL SELECT * FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY edge_type ORDER BY weight DESC, other) AS n FROM u) SELECT edge_type, CASE WHEN n <= CASE edge_type WHEN 'donor' THEN 40 ELSE 25 END THEN other ELSE 'other' END AS other, round(sum(weight), 2) AS weight, count(*) AS edges FROM r GROUP BY 1, 2")
def _(t):
    donors = good(t).where("committee_id = 1").groupBy("donor_key").agg(F.sum("amount").alias("weight")).select(F.lit("donor").alias("edge_type"), F.col("donor_key").alias("src"), F.lit("me").alias("dst"), "weight")
    vendors = t.expenditures.where("committee_id = 1 AND (d2_part IS NULL OR d2_part NOT LIKE '9%')").groupBy("payee_name").agg(F.sum("amount").alias("weight")).select(F.lit("vendor").alias("edge_type"), F.lit("me").alias("src"), F.col("payee_name").alias("dst"), "weight")
    return graph.ego(donors.unionByName(vendors), "me", {"donor": 40, "vendor": 25})


@query("channel_graph", f"WITH c AS (SELECT state AS src, 'k' || committee_id AS dst, 'receipt' AS channel, amount AS weight, strftime(received_date, '%Y-%m') AS month FROM receipts WHERE {GOOD} UNION ALL SELECT 'k' || committee_id, payee_name, 'payment', amount, strftime(expended_date, '%Y-%m') FROM expenditures), b AS (SELECT src AS node, channel, weight, month FROM c UNION ALL SELECT dst, channel, weight, month FROM c) SELECT node, bit_or(CASE channel WHEN 'receipt' THEN 1 ELSE 2 END)::INT AS channel_mask, round(ln(1 + sum(weight)) + ln(1 + count(*)), 4) AS size, count(DISTINCT month) AS months FROM b GROUP BY 1")
def _(t):
    node = F.concat(F.lit("k"), F.col("committee_id").cast("string"))
    a = good(t).select(F.col("state").alias("src"), node.alias("dst"), F.lit("receipt").alias("channel"), F.col("amount").alias("weight"), F.date_format("received_date", "yyyy-MM").alias("month"))
    b = t.expenditures.select(node.alias("src"), F.col("payee_name").alias("dst"), F.lit("payment").alias("channel"), F.col("amount").alias("weight"), F.date_format("expended_date", "yyyy-MM").alias("month"))
    return graph.channel_graph(a.unionByName(b), ["receipt", "payment"])


def _rank_sql(rounds: int = 25, damping: float = 0.85) -> str:
    """The rounds of PageRank one by one; ends with `pr` (node, rank relative to the largest)."""
    ctes = [NET, BOTH, "w AS (SELECT node, other, sum(weight) AS w FROM b GROUP BY ALL)", "tot AS (SELECT node, sum(w) AS total FROM w GROUP BY 1)", "sh AS MATERIALIZED (SELECT node, other, w / total AS p FROM w JOIN tot USING (node) WHERE total > 0)", "nn AS (SELECT count(*) AS n FROM tot)", "r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / n AS rank FROM tot, nn)"]
    for i in range(rounds):
        ctes.append(f"r{i + 1} AS MATERIALIZED (SELECT t.node, (1 - {damping}::DOUBLE) / n + {damping}::DOUBLE * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} JOIN tot USING (node) WHERE total <= 0) / n) AS rank FROM tot t CROSS JOIN nn LEFT JOIN (SELECT other, sum(p * rank) AS got FROM sh JOIN r{i} USING (node) GROUP BY 1) g ON t.node = g.other)")
    return ", ".join(ctes) + f", pr AS (SELECT node, round(rank / (SELECT max(rank) FROM r{rounds}), 6) AS rank FROM r{rounds})"


@query("pagerank_fixed_iter", f"WITH {_rank_sql()} SELECT * FROM pr")
def _(t):
    return graph.pagerank(network(t))


@query("influence_score", f"WITH {_rank_sql()}, d AS (SELECT node, round(sum(weight), 2) AS wd, count(DISTINCT other) AS dg, split_part(node, ':', 1) AS kind FROM b GROUP BY 1) SELECT node, kind, round(0.55::DOUBLE * wd / max(wd) OVER (PARTITION BY kind) + 0.25::DOUBLE * dg / max(dg) OVER (PARTITION BY kind) + 0.20::DOUBLE * rank / max(rank) OVER (), 4) AS influence FROM d JOIN pr USING (node)")
def _(t):
    net = network(t)
    degrees = graph.degree_centrality(net)
    return graph.influence(degrees, graph.pagerank(net), degrees.select("node", F.split_part("node", F.lit(":"), F.lit(1)).alias("kind")))


@query("network_metrics")
def _(t):
    labels = small_network(t).select(F.col("src").alias("node")).distinct().withColumn("label", F.lit("state")).unionByName(t.committees.select(F.concat(F.lit("committee:"), F.col("committee_id").cast("string")).alias("node"), F.when(F.col("nation_id") % 2 == 0, "state").otherwise("federal").alias("label")))
    return graph.metrics(small_network(t), labels)


@query("label_propagation")
def _(t):
    return kernels.label_propagation(small_network(t))


@query("louvain")
def _(t):
    return kernels.louvain(small_network(t))


@query("betweenness")
def _(t):
    return kernels.betweenness(small_network(t))


@query("money_destinations", f"WITH s AS (SELECT state, committee_id, round(sum(amount), 2) AS flow FROM receipts WHERE {GOOD} GROUP BY ALL) SELECT state, committee_id, flow FROM s WHERE flow >= 1000 ORDER BY flow DESC, state, committee_id LIMIT 100")
def _(t):
    flows = good(t).groupBy("state", "committee_id").agg(F.round(F.sum("amount"), 2).alias("flow"))
    return flows.where("flow >= 1000").orderBy(F.desc("flow"), "state", "committee_id").limit(100)


@query("transfer_chains", "WITH t AS (SELECT donor_id % 100 AS payer, committee_id AS payee, round(sum(amount), 2) AS amount FROM receipts WHERE d2_part LIKE '2A%' AND amount > 0 GROUP BY ALL) SELECT a.payer, a.payee AS middle, b.payee AS receiver, least(a.amount, b.amount) AS through FROM t a JOIN t b ON a.payee = b.payer WHERE a.amount >= 250000 AND b.amount >= 250000")
def _(t):
    moves = t.receipts.where("d2_part LIKE '2A%' AND amount > 0").groupBy((F.col("donor_id") % 100).alias("payer"), F.col("committee_id").alias("payee")).agg(F.round(F.sum("amount"), 2).alias("amount")).where("amount >= 250000")
    a, b = moves.alias("a"), moves.alias("b")
    return a.join(b, F.col("a.payee") == F.col("b.payer")).select(F.col("a.payer").alias("payer"), F.col("a.payee").alias("middle"), F.col("b.payee").alias("receiver"), F.least("a.amount", "b.amount").alias("through"))


_LAYERS = f"""a AS (SELECT 'receipt' AS layer, state AS src, 'k' || committee_id AS dst, round(sum(amount), 2) AS weight FROM receipts WHERE {GOOD} GROUP BY ALL), b AS (SELECT 'payment' AS layer, 'k' || committee_id AS src, payee_name AS dst, round(sum(amount), 2) AS weight FROM expenditures WHERE d2_part IS NULL OR d2_part NOT LIKE '9%' GROUP BY ALL),
o AS (SELECT 'outside' AS layer, 'k' || committee_id AS src, 'c' || candidate_id AS dst, round(sum(amount), 2) AS weight FROM expenditures WHERE d2_part LIKE '9%' GROUP BY ALL)"""
_TOP50 = "SELECT * FROM (SELECT * FROM {x} ORDER BY weight DESC, src, dst LIMIT 50)"


@query("multilayer_network", f"WITH {_LAYERS} SELECT layer, src, dst, weight FROM ({' UNION ALL '.join(_TOP50.format(x=x) for x in 'abo')}) ORDER BY weight DESC, layer, src, dst LIMIT 120")
def _(t):
    node = F.concat(F.lit("k"), F.col("committee_id").cast("string"))
    outside = F.coalesce(F.col("d2_part").startswith("9"), F.lit(False))
    total = F.round(F.sum("amount"), 2).alias("weight")
    return graph.capped_layers({
        "receipt": good(t).groupBy(F.col("state").alias("src"), node.alias("dst")).agg(total),
        "payment": t.expenditures.where(~outside).groupBy(node.alias("src"), F.col("payee_name").alias("dst")).agg(total),
        "outside": t.expenditures.where(outside).groupBy(node.alias("src"), F.concat(F.lit("c"), F.col("candidate_id").cast("string")).alias("dst")).agg(total),
    }, 50, 120)


@query("federal_donor_candidates", f"WITH {EDGES}, {_MONEY}, g AS (SELECT donor_key, candidate_id, round(sum(total_amount / n), 6) AS amount FROM e JOIN lk USING (committee_id) JOIN lc USING (committee_id) JOIN candidate_book USING (candidate_id) WHERE register = 'federal' GROUP BY ALL) SELECT donor_key AS src, candidate_id AS dst, round(amount + 1e-7::DOUBLE, 2) AS weight FROM g ORDER BY round(amount + 1e-7::DOUBLE, 2) DESC, donor_key, candidate_id LIMIT 1000")
def _(t):
    federal = t.links.join(t.candidate_book.where("register = 'federal'").select("candidate_id"), "candidate_id", "left_semi")
    money = graph.candidate_money_of(edges(t).select("donor_key", "committee_id", "total_amount"), t.links, federal)
    return money.select(F.col("donor_key").alias("src"), F.col("candidate_id").alias("dst"), F.round(F.col("amount") + F.lit(1e-7), 2).alias("weight")).orderBy(F.desc("weight"), "src", "dst").limit(1000)
