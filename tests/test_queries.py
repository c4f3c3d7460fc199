"""Every registered query against its DuckDB oracle on the smallest tables."""

import os
from collections import Counter

import pytest

from ledgerlens.plans.registry import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(found):
    return Counter(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    expect = duck.execute("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({ORACLES[name]}) x").fetchall()
    assert rows(tuple(r) for r in got.select(*[f"`{c}`" for c in cols]).collect()) == rows(expect)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_money_hops_over_all_edges(spark, duck):
    from collections import defaultdict

    from ledgerlens.sources.civic import with_views

    network = [(r["src"], r["dst"]) for r in QUERIES["network_edges"](spark, SF).collect()]
    links = duck.execute(with_views("SELECT 'committee:' || committee_id, 'candidate:' || candidate_id FROM links")).fetchall()
    near = defaultdict(set)
    for a, b in network + links:
        near[a].add(b)
        near[b].add(a)
    hop, front = {"committee:1": 0}, {"committee:1"}
    for n in (1, 2, 3):
        front = {y for x in front for y in near[x]} - hop.keys()
        hop.update(dict.fromkeys(front, n))
    got = [(r["node"], r["hop"]) for r in QUERIES["money_hops"](spark, SF).collect()]
    assert len(got) == len(hop) and dict(got) == hop and {n.split(":")[0] for n in hop} == {"donor", "committee", "candidate"}


def test_influence_of_every_node(spark):
    from collections import defaultdict

    near, money = defaultdict(dict), defaultdict(float)
    for r in QUERIES["network_edges"](spark, SF).collect():
        for a, b in ((r["src"], r["dst"]), (r["dst"], r["src"])):
            near[a][b] = near[a].get(b, 0.0) + r["weight"]
            money[a] += r["weight"]
    n, rank = len(near), dict.fromkeys(near, 1 / len(near))
    for _ in range(25):
        lost = sum(rank[x] for x in near if money[x] <= 0)
        got = defaultdict(float)
        for x in near:
            for y, w in near[x].items() if money[x] > 0 else ():
                got[y] += rank[x] * w / money[x]
        rank = {x: 0.15 / n + 0.85 * (got[x] + lost / n) for x in near}
    kind = lambda x: x.split(":")[0]
    most = {k: (max(money[x] for x in near if kind(x) == k), max(len(near[x]) for x in near if kind(x) == k)) for k in ("donor", "committee")}
    top = max(rank.values())
    expect = {x: 0.55 * money[x] / most[kind(x)][0] + 0.25 * len(near[x]) / most[kind(x)][1] + 0.20 * rank[x] / top for x in near}
    got = {r["node"]: (r["kind"], r["influence"]) for r in QUERIES["influence_score"](spark, SF).collect()}
    assert got.keys() == expect.keys() and all(k == kind(x) and abs(v - expect[x]) < 2e-4 for x, (k, v) in got.items())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
