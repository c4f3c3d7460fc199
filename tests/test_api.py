"""Endpoints and the command line."""

import os
from datetime import date

import pytest

from ledgerlens import __main__ as cli
from ledgerlens.api import ROUTES, Api, call
from ledgerlens.functions.predicates import Scope

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
NEEDS = {
    "committee": {"committee_id": 1}, "committee_donors": {"committee_id": 1}, "committee_payees": {"committee_id": 1}, "committee_filings": {"committee_id": 1}, "filing": {"filing_id": 1},
    "donor": {"donor_key": "customer#000000001|furniture|nation_19"}, "candidate": {"candidate_id": 1}, "candidate_itemized": {"committee_id": 1}, "outside_spending": {}, "race": {"race_key": "Brand#1"},
    "relationships": {"committee_ids": [1]}, "geo_drilldown": {"state": "NATION_3"}, "focus": {"committee_id": 1}, "suggest": {"text": "supp"}, "search": {"text": "gear"},
    "compare": {"left": 1, "right": 2}, "trace_money": {"donor_key": "x"}, "freshness": {"today": date(2001, 12, 31)},
    "matches": {"job": "client_donors"}, "person": {"text": "small"}, "ledger527": {"ein": 1},
}


@pytest.mark.parametrize("path", sorted(ROUTES))
def test_routes(spark, path):
    rows = call(Api(spark, SF), path, **NEEDS.get(ROUTES[path], {})).limit(3).collect()
    # Some answers are rightly empty on the smallest tables.
    assert rows or ROUTES[path] in ("reconciliation", "relationships", "vendor_network", "races", "family_review", "compare", "outside_spending", "similarity", "candidate_itemized", "person")


def test_scope_limits_receipts(spark):
    whole, part = Api(spark, SF), Api(spark, SF, Scope(date(1997, 1, 1), date(1997, 12, 31)))
    assert 0 < part.receipts().count() < whole.receipts().count()
    assert part.receipts().where("received_date IS NULL OR year(received_date) <> 1997").count() == 0


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "donor_concentration" in capsys.readouterr().out
    assert cli.main(["run", "geo_states", "--data", SF, "--out", str(tmp_path / "g"), "--format", "csv"]) == 0
    assert spark.read.csv(str(tmp_path / "g"), header=True).count() == 25
    assert cli.main(["refresh-analytics", "--data", SF, "--out", str(tmp_path / "gold")]) == 0
    assert spark.read.parquet(str(tmp_path / "gold/donor_committee")).count() > 0
    assert cli.main(["route", "/search", "--data", SF, "--params", '{"text": "gear"}']) == 0
    assert cli.main(["validate-freshness", "--data", SF, "--today", "2001-11-10"]) in (0, 1)
    assert cli.main(["census", "part", "--data", SF]) == 0
    assert cli.main(["match", "client_orgs", "--data", SF, "--out", str(tmp_path / "m")]) == 0 and spark.read.parquet(str(tmp_path / "m")).columns == ["client_id", "client_name", "ein", "org_name", "score"]
    (tmp_path / "links.txt").write_text("ID\tC\tK\n1\t2\t3\nx\t2\t3\n")
    assert cli.main(["feed", "CmteCandidateLinks", "--data", str(tmp_path / "links.txt"), "--out", str(tmp_path / "f")]) == 0
    assert spark.read.parquet(str(tmp_path / "f/rows")).count() == spark.read.parquet(str(tmp_path / "f/rejects")).count() == 1
