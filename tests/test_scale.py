"""Cases that show only on larger tables, in small."""

from __future__ import annotations

import os
import shutil

import pytest

from ledgerlens.plans.registry import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def changed(folder, **tables: str):
    """A copy of the tables, those named as their SQL over the originals; returns the folder and a DuckDB connection over it."""
    con = duckdb.connect()
    for t in TABLES:
        if t in tables:
            con.execute(f"COPY ({tables[t].format(t=f"'{SF}/{t}.parquet'")}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        else:
            shutil.copy(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


def same(spark, name, folder, con):
    got = QUERIES[name](spark, folder)
    expect = con.execute("SELECT " + ", ".join(f'"{c}"' for c in got.columns) + f" FROM ({ORACLES[name]}) x").fetchall()
    assert expect and sorted(map(tuple, got.collect()), key=repr) == sorted(expect, key=repr)


def test_directory_search_finds_substrings_beside_word_prefixes(spark, tmp_path):
    folder, con = changed(tmp_path, customer="SELECT * REPLACE (CASE WHEN c_custkey % 7 = 0 THEN 'Customer#00012' || lpad(c_custkey::VARCHAR, 4, '0') ELSE c_name END AS c_name) FROM {t}")
    same(spark, "donor_directory_search", folder, con)


def test_graph_kernels_take_any_number_of_edges(spark):
    from pyspark.sql import functions as F

    from ledgerlens.operators import graph, kernels

    n = 320  # two complete bipartite graphs, more edges than the kernels once took
    half, a, b = F.col("id") % 2, (F.col("id") / 2).cast("long") % n, F.floor(F.col("id") / (2 * n))
    name = lambda side, i: F.concat(F.lit(f"{side}:"), half.cast("string"), F.lit(":"), i.cast("string"))
    edges = spark.range(2 * n * n).select(name("a", a).alias("src"), name("b", b).alias("dst"), F.lit(1.0).alias("weight"))
    for kernel, column in ((kernels.label_propagation, "cluster"), (kernels.louvain, "community")):
        found = {r["node"]: r[column] for r in kernel(edges).collect()}
        assert len(found) == 4 * n and len({(k.split(":")[1], v) for k, v in found.items()}) == len(set(found.values())) == 2
    # A search from one side gives each node of the other (n - 1) / n: a side's value tells how many of the 64 pivots lie opposite.
    sides = {}
    for r in kernels.betweenness(edges).collect():
        sides.setdefault(r["node"].rpartition(":")[0], set()).add(r["betweenness"])
    scale = 4 * n / 64 / (4 * n - 1) / (4 * n - 2)
    assert len(sides) == 4 and all(len(v) == 1 for v in sides.values()) and abs(sum(v.pop() for v in sides.values()) / scale * n / (n - 1) - 64) < 0.2
    labels = edges.select(F.col("src").alias("node"), F.lit("x").alias("label")).distinct()
    row = graph.metrics(edges, labels).where("node = 'a:0:7'").collect()
    assert [(r["degree"], r["weighted_degree"], r["known_edges"]) for r in row] == [(n, float(n), 0)]


def test_addresses_in_tiles_equal_whole_blocks(spark):
    from pyspark.sql import functions as F

    from ledgerlens.operators import crossmatch

    words = F.array(*[F.lit(w) for w in ("steel works", "stone mill", "river fund", "still water", "ston mills")])
    rows = spark.range(120).select((F.col("id") % 50).alias("own"), F.concat(F.get(words, (F.col("id") % 5).cast("int")), F.lit(" "), (F.col("id") % 7).cast("string")).alias("name"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("City "), (F.col("id") % 3).cast("string"))).alias("city"), F.lit("IL").alias("state"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("6050"), (F.col("id") % 2).cast("string"))).alias("zip"))
    right = rows.select(*[F.col(c).alias(f"{c}2") for c in rows.columns])
    args = (rows, right, "name", "name2", (("city", "state", "zip"), ("city2", "state2", "zip2")), 0.3, ["own", "own2"])
    got = {(r["own"], r["own2"], r["address_score"], r["name_score"]) for r in crossmatch.match_addresses(*args, keep=["own", "own2"], tile=16).collect()}
    con = duckdb.connect()
    con.register("t", rows.toPandas())
    from ledgerlens.plans.queries_cross import addresses_sql

    expect = con.execute(addresses_sql("SELECT * FROM t", "name", "", "SELECT own AS own2, name AS name2, city AS c2, state AS s2, zip AS z2 FROM t", "name2", "own, own2", "own, own2", 0.3)).fetchall()
    # The SQL scores no city as another city, and so does the operator.
    assert len(got) == len(expect) > 300 and got == {tuple(r) for r in expect}


def test_candidate_score_without_all_pairs(spark, tmp_path):
    # Copies of each part under other keys, two brands, few types and sizes: crowded brands, many ties and no pair of rows made for them.
    part = "SELECT p_partkey + k * 1000000 AS p_partkey, p_name, 'Brand#' || (p_partkey % 2) AS p_brand, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS p_type, p_size % 4 AS p_size, p_retailprice FROM {t}, range(3) k(k)"
    folder, con = changed(tmp_path, part=part)
    same(spark, "candidate_score_top2", folder, con)
    nodes = QUERIES["candidate_score_top2"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "p_partkey" in nodes and not any("NOT (p_partkey" in x and "p_brand" in x for x in nodes.split("\n") if "Join" in x)


def test_candidate_score_broadcasts_no_rows(spark, tmp_path):
    # Repeated rows make small files of large tables: those must not be gathered on the driver to be broadcast.
    folder, _ = changed(tmp_path, part="SELECT p_partkey + k * 1000000 AS p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM {t}, range(200) k(k)")
    found = QUERIES["candidate_score_top2"](spark, folder)
    rows = spark.read.parquet(f"{folder}/part.parquet").count()
    assert found.count() == rows  # each brand has several
    found.write.format("noop").mode("overwrite").save()
    found.collect()
    sent, nodes = [], [found._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name == "BroadcastExchange":
            sent.append(node.metrics().apply("numOutputRows").value())
        nodes += [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if hasattr(node, "plan") and "QueryStage" in name else [node.children().apply(i) for i in range(node.children().size())]
    assert sum(sent) < rows / 2


def test_candidate_score_on_odd_rows(spark, tmp_path):
    # Null and empty names, null ids, brands, types and sizes, a brand of one row, repeated rows and ids with several rows.
    name = "CASE p_partkey % 11 WHEN 1 THEN NULL WHEN 2 THEN '--' WHEN 3 THEN p_name || ' ring' ELSE p_name END"
    odd = f"SELECT p_partkey, {name} AS p_name, CASE WHEN p_partkey = 0 THEN 'one' WHEN p_partkey % 23 > 0 THEN 'Brand#' || (p_partkey % 5) END AS p_brand, CASE WHEN p_partkey % 7 > 0 THEN p_type END AS p_type, CASE WHEN p_partkey % 13 > 0 THEN p_size % 3 END::INTEGER AS p_size, p_retailprice FROM {{t}}"
    empty = "SELECT 5000 + i, CASE WHEN i % 2 = 0 THEN '' END, 'blank' || (i // 4), CASE WHEN i % 3 > 0 THEN 'X' END, 1, 1.0 FROM range(12) r(i)"
    twice = f"SELECT * FROM ({odd}) UNION ALL SELECT * FROM ({odd}) WHERE p_partkey % 10 = 0 UNION ALL SELECT * REPLACE (p_partkey + 5 AS p_partkey) FROM ({odd}) WHERE p_partkey % 20 = 4 UNION ALL SELECT * REPLACE (NULL::BIGINT AS p_partkey) FROM ({odd}) WHERE p_partkey % 50 = 6 UNION ALL {empty}"
    folder, con = changed(tmp_path, part=twice)
    got = QUERIES["candidate_score_top2"](spark, folder)
    expect = con.execute("SELECT " + ", ".join(got.columns) + f" FROM ({ORACLES['candidate_score_top2']}) x").fetchall()
    found = sorted(map(repr, map(tuple, got.collect())))  # as text, since NaN differs from itself
    assert found == sorted(map(repr, expect)) and any("nan" in x for x in found) and any("None, None" in x for x in found)


def test_infer_links_by_lists(spark, tmp_path):
    from ledgerlens.operators import directory

    folder, con = changed(tmp_path, part="SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'red bolt' ELSE p_name END AS p_name, p_brand, p_type, p_size, p_retailprice FROM {t}")
    same(spark, "infer_links", folder, con)
    links = spark.createDataFrame([(1, 10), (2, 11), (1, 12)], "committee_id long, candidate_id long")
    people = spark.createDataFrame([*((i, "Lee", " Ann") for i in range(10, 20)), (20, "Lee", "Ann"), (20, "Moe", "Bo"), (20, "Lee", "Ann"), (21, "Fox", "Cy")], "candidate_id long, last_name string, first_name string")
    whom = spark.createDataFrame([*((i, "LEE, Ann ") for i in range(1, 6)), (1, "moe, bo"), (1, "lee, ann"), (7, None)], "committee_id long, refer_name string")
    found = directory.infer_links(links, people, whom, tile=3)
    expect = {(c, p) for c in range(1, 6) for p in range(10, 21)} - {(1, 10), (2, 11), (1, 12)}
    assert sorted(map(tuple, found.collect())) == sorted(expect)
