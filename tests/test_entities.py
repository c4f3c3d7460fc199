"""Entity resolution against brute force, with rows that tell the rules apart."""

import difflib
import os
import re

import pandas as pd
import pytest

from ledgerlens.functions import text
from ledgerlens.operators import crossmatch, entities, families, kernels, reports
from ledgerlens.plans.registry import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def slow_pairs(rows, least):
    legal = "inc llc ltd co corp corporation company assoc association assn group pllc llp lp".split()
    stop = "the of for and in a an to committee fund pac political action".split()
    clean = lambda s: [w for w in re.sub("[^a-z0-9]", " ", (s or "").lower().replace("&", " and ")).split()]
    jac = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    made = []
    for r in rows:
        n = [w for w in clean(r["name"]) if w not in legal]
        made.append((r, " ".join(n), [w for w in n if w not in stop], " ".join(text.ADDRESS_WORDS.get(w, w) for w in clean(r["address"])), {" ".join(x for x in clean(o) if x not in legal) for o in r["officers"] or []} - {""}))
    out = {}
    for x, n1, t1, a1, o1 in made:
        for y, n2, t2, a2, o2 in made:
            if x["id"] >= y["id"] or not t1 or not t2 or t1[0] != t2[0]:
                continue
            name = 1.0 if n1 == n2 else 0.6 * jac(set(t1), set(t2)) + 0.4 * difflib.SequenceMatcher(None, n1, n2).ratio()
            z = lambda r: (re.findall(r"\\d{5}", r["zip"] or "") or [""])[0]
            low = lambda r: ((r["city"] or "").strip().lower(), (r["state"] or "").strip().upper())
            place = 1.0 if a1 and a1 == a2 else 0.8 if z(x) and z(x) == z(y) else 0.6 if all(low(x)) and low(x) == low(y) else 0.0
            score = 0.6 * name + 0.25 * place + 0.15 * jac(o1, o2)
            if score >= least - 1e-9:
                out[x["id"], y["id"]] = score
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("least", [0.92, 0.85, 0.7])
def test_profiles_against_brute_force(spark, least):
    from ledgerlens.plans.catalog import Tables
    from ledgerlens.plans.queries_match import profiles

    rows = profiles(Tables(spark, SF)).where("name IS NOT NULL")
    got = {(r["src"], r["dst"]): r["score"] for r in entities.profile_pairs(rows, least).collect()}
    expect = slow_pairs([r.asDict() for r in rows.collect()], least)
    assert got.keys() == expect.keys() and all(got[k] == pytest.approx(expect[k], abs=1e-4) for k in got)
    if least == 0.7:
        assert got


def test_resolver_query_uses_both_branches(spark):
    found = {r["id"]: r["profile"] for r in QUERIES["profile_resolver"](spark, SF).collect()}
    assert len(found) > len(set(found.values())) > 1


def person(i, **more):
    return {"donor_key": f"k{i:03}", "donor_name": "Ann Lee", "full_name": "ann lee", "total_amount": 10.0, "address": None, "city": None, "state": None, "zip": None, "employer": None, "occupation": None} | more


def entity_of(rows):
    return {r.donor_key: (r.entity_id, r.status) for r in kernels.link_records(pd.DataFrame(rows)).itertuples()}


def test_record_linkage_rules():
    # Two homes in a city, one employer.
    homes = entity_of([person(1, address="1 Oak St", city="Aurora", state="IL", employer="Acme Steel"), person(2, address="9 Elm Ave", city="Aurora", state="IL", employer="Acme Steel Inc")])
    assert homes["k001"][0] == homes["k002"][0]
    # Nothing but the name.
    apart = entity_of([person(1, city="Aurora", state="IL"), person(2, city="Joliet", state="IL")])
    assert apart["k001"][0] != apart["k002"][0]
    # One company in two cities: only large sums bridge it, and only to review.
    rich = [person(1, city="Aurora", state="IL", employer="Citadel Partners North", total_amount=2e6), person(2, city="Joliet", state="IL", employer="Citadel Partners South LLC")]
    found = entity_of(rich)
    assert found["k001"][0] == found["k002"][0] and found["k001"][1] == "review"
    poor = entity_of([r | {"total_amount": 10.0} for r in rich])
    assert poor["k001"][0] != poor["k002"][0]
    far = entity_of([rich[0] | {"total_amount": 6e6}, rich[1] | {"state": "FL"}])
    assert far["k001"][0] != far["k002"][0]  # another state needs the company in the other's occupation as well
    crossed = entity_of([rich[0] | {"total_amount": 6e6}, rich[1] | {"state": "FL", "occupation": "citadel broker"}])
    assert crossed["k001"][0] == crossed["k002"][0]


def test_large_groups_use_all_block_keys():
    """Above 80 records only blocks are paired: a city of over 200 records is too common, its finer blocks and companies are not."""
    crowd = [person(i, city="Chicago", state="IL", address=f"{i} {chr(97 + i % 26)}{i} way") for i in range(230)]
    crowd += [person(300, city="Chicago", state="IL", address="77 Lake Shore Dr", employer="Zeta Works", zip="60601"), person(301, city="Chicago", state="IL", address="77 Lake Shore Drive Apt 4", employer="Zeta Works", zip="60602")]
    crowd += [person(302, city="Cairo", state="IL", employer="Quark Labs", total_amount=3e6), person(303, city="Peoria", state="IL", employer="Quark Labs")]
    found = entity_of(crowd)
    assert found["k300"][0] == found["k301"][0] and found["k302"][0] == found["k303"][0]
    assert len({e for e, _ in found.values()}) == len(crowd) - 2


def test_family_signs(spark):
    c = spark.createDataFrame([(1, "Friends of Ann", "1 Main St.", "60601", "x"), (2, "FRIENDS of ann", None, None, None), (3, "Ann for Mayor", "1 main st", "60601", " X"), (4, "Zed", "9 Elm", "60602", "y"), (5, "Friends of Anne", "", "60601", None)], "committee_id long, committee_name string, street string, zip string, officer string")
    links = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 7), (5, 8)], "committee_id long, candidate_id long")
    got = {(r["c1"], r["c2"]): (r["same_name"], r["similar_name"], r["same_address"], r["shared_officer"]) for r in families.strong_pairs(c, links, families.officers(c)).collect()}
    assert got == {(1, 2): (True, True, False, False), (1, 3): (False, False, True, True)}
    assert {(r["c1"], r["c2"]) for r in families.weak_pairs(c.where("committee_id in (1, 5)"), links).collect()} <= {(1, 5)}
    found = {r["committee_id"]: r["family_id"] for r in families.families(families.strong_pairs(c, links, families.officers(c))).collect()}
    assert found == {1: 1, 2: 1, 3: 1}


def test_matching_jobs_edges(spark):
    left = spark.createDataFrame([(1, "The Acme Steel Co"), (2, None), (3, "Committee Fund"), (4, "acme steel"), (1, "Acme, Steel!")], "a long, n string")
    right = spark.createDataFrame([(9, "ACME STEEL, LLC"), (8, "Acme Iron"), (7, None), (6, "")], "b long, m string")
    got = sorted((r["a"], r["n"], r["b"], r["score"]) for r in crossmatch.match_names(left, right, "n", "m").collect())
    assert got == [(1, "Acme, Steel!", 9, 1.0), (1, "The Acme Steel Co", 9, 1.0), (4, "acme steel", 9, 1.0)]
    best = crossmatch.match_names(left, right, "n", "m", best=["a", "b"]).collect()
    assert sorted((r["a"], r["n"]) for r in best) == [(1, "Acme, Steel!"), (4, "acme steel")]
    empty = crossmatch.match_names(left.where("false"), right, "n", "m")
    assert empty.collect() == [] and empty.columns == ["a", "n", "b", "m", "score"]


def test_addresses_with_threshold_zero(spark):
    place = "k long, name string, city string, state string, zip string"
    left = spark.createDataFrame([(1, "Ann Lee", "Aurora", "IL", "60505-1"), (2, "Bo", "Aurora", None, "60505"), (3, "Cy", "X", "IL", "  ")], place)
    right = left.select(*[left[c].alias(f"{c}2") for c in left.columns]).union(spark.createDataFrame([(4, "Zed Moe", "Elgin", " il", "60505")], place))
    args = ("name", "name2", (("city", "state", "zip"), ("city2", "state2", "zip2")))
    got = sorted((r["k"], r["k2"], r["address_score"], r["name_score"]) for r in crossmatch.match_addresses(left, right, *args, 0.0, ["k", "k2"]).collect())
    assert got == [(1, 1, 1.0, 1.0), (1, 4, 0.7, 0.0)]
    assert [(r["k"], r["k2"]) for r in crossmatch.match_addresses(left, right, *args, 0.3, ["k", "k2"]).collect()] == [(1, 1)]


def test_report_defaults(spark):
    e = spark.createDataFrame([("a", 1, "A", 800_000.0, 3), ("b", 1, "B", 100_000.0, 1), ("a", 2, "A", 400_000.0, 1), ("c", 3, "C", 700_000.0, 1), ("d", 3, "D", 300_000.0, 1)], "donor_key string, committee_id long, donor_name string, total_amount double, contribution_count long")
    names = spark.createDataFrame([(1, "One"), (2, "Two"), (3, "Three")], "committee_id long, committee_name string")
    assert [(r["committee_id"], r["donor_name"], r["pct_of_total"]) for r in reports.dominance(e, names).collect()] == [(1, "A", 88.9)]
    feed = reports.candidacy_feed(spark.createDataFrame([(1, 2025), (2, 2026), (3, 2023)], "candidate_id long, year int"), spark.createDataFrame([(1, 10), (1, 11)], "candidate_id long, committee_id long"))
    assert sorted((r["candidate_id"], r["committee_id"] or 0, r["cycle"]) for r in feed.collect()) == [(1, 10, 2026), (1, 11, 2026), (2, 0, 2026), (3, 0, 2024)]


def test_name_search_rules(spark):
    rows = spark.createDataFrame([(1, "Michael Frerichs"), (2, "Mike O'Neil"), (3, "ONEIL, Sam"), (4, "Neil O. Ray"), (5, "Law Office of Neil"), (6, "Women Lead"), (7, "Pritzker, Jay Robert")], "k long, n string")
    find = lambda q: sorted(r["k"] for r in rows.where(text.name_matches(rows["n"], q)).collect())
    assert find("Mike") == [1, 2] and find("michael") == [1, 2] and find("frer mike w.") == [1]
    assert find("O'Neil") == [2, 3] and find("Women's") == [6] and find("jb prit") == [7] and find(" ") == []
    assert sorted(r["k"] for r in rows.where(text.contains_fallback(rows["n"], "O'Neil")).collect()) == [2]
    assert rows.where(text.contains_fallback(rows["n"], "nei")).count() == 0
