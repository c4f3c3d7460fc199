"""Data endpoints as functions: each takes parameters and returns a DataFrame. HTTP, login and drawing are out of scope."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.predicates import Scope, contributions, vendor_rows
from ledgerlens.functions.text import name_matches, spending_category
from ledgerlens.operators import anomalies, concentration, directory, entities, families, federal, filings, geography, graph, kernels, org527, races, rollups, trends
from ledgerlens.plans.catalog import Tables
from ledgerlens.plans.registry import QUERIES


class Api:
    """Endpoints over one folder of tables. `scope` limits receipts and spending by date, inclusive on both ends."""

    def __init__(self, spark: SparkSession, data_dir: str, scope: Scope = Scope()):  # noqa: B008
        self.t, self.scope = Tables(spark, data_dir), scope

    # shared inputs

    def receipts(self) -> DataFrame:
        return self.t.receipts.where(contributions() & self.scope.where("received_date"))

    def spending(self) -> DataFrame:
        return self.t.expenditures.where(self.scope.where("expended_date"))

    def edges(self) -> DataFrame:
        return rollups.donor_committee(self.receipts())

    # lists and details

    def stats(self) -> DataFrame:
        counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in (("committees", self.t.committees), ("candidates", self.t.candidates), ("filings", self.t.filings), ("receipts", self.t.receipts), ("expenditures", self.t.expenditures))]
        out = counts[0]
        for c in counts[1:]:
            out = out.unionByName(c)
        return out

    def committees(self, search: str | None = None, sort: str = "name", direction: str = "asc", size: int = 50, page: int = 1) -> DataFrame:
        sums = self.receipts().groupBy("committee_id").agg(F.round(F.sum("amount"), 2).alias("received"))
        rows = self.t.committees.join(sums, "committee_id", "left")
        return directory.directory(rows, search, "committee_name", {"name": "committee_name", "received": "received", "funds": "funds"}, sort, direction, size, page, "committee_id")

    def committee(self, committee_id: int) -> DataFrame:
        own = concentration.concentration(self.edges().where(F.col("committee_id") == committee_id))
        return self.t.committees.where(F.col("committee_id") == committee_id).join(own, "committee_id", "left")

    def committee_donors(self, committee_id: int, size: int = 20, page: int = 1) -> DataFrame:
        return geography.page(self.edges().where(F.col("committee_id") == committee_id), [F.desc("total_amount"), F.col("donor_key")], size, page)

    def committee_payees(self, committee_id: int, size: int = 20, page: int = 1) -> DataFrame:
        rows = rollups.payee_rollup(self.spending().where((F.col("committee_id") == committee_id) & vendor_rows()))
        return geography.page(rows, [F.desc("total_amount"), F.col("payee_key")], size, page)

    def committee_filings(self, committee_id: int) -> DataFrame:
        return filings.live_filings(self.t.filings.where(F.col("committee_id") == committee_id)).orderBy(F.desc("period_end"), F.desc("filing_id"))

    def filing(self, filing_id: int) -> DataFrame:
        return filings.mismatch_status(filings.reconcile(self.t.filings.where(F.col("filing_id") == filing_id), self.t.receipts.where(F.col("filing_id") == filing_id)))

    def reports(self, size: int = 50, page: int = 1) -> DataFrame:
        return geography.page(self.t.filings, [F.col("received_on").desc_nulls_last(), F.desc("filing_id")], size, page)

    def donors(self, search: str | None = None, sort: str = "amount", direction: str = "desc", size: int = 50, page: int = 1) -> DataFrame:
        rows = rollups.donor_summary(self.edges())
        return directory.directory(rows, search, "donor_name", {"amount": "total_amount", "name": "donor_name", "count": "contribution_count"}, sort, direction, size, page, "donor_key")

    def donor(self, donor_key: str) -> DataFrame:
        return federal.donor_detail(self.receipts(), donor_key)

    def candidates(self) -> DataFrame:
        return federal.candidate_totals(self.t.candidates, self.receipts(), self.t.links, self.spending().where("d2_part LIKE '9%'"))

    def candidate(self, candidate_id: int) -> DataFrame:
        return self.candidates().where(F.col("candidate_id") == candidate_id)

    def candidate_itemized(self, committee_id: int, size: int = 50, page: int = 1) -> DataFrame:
        rows = self.receipts().where(F.col("committee_id") == committee_id).select("filing_id", "donor_name", "amount", "received_date", "d2_part")
        return geography.page(rows, [F.col("received_date").desc_nulls_last(), F.desc("amount"), F.col("filing_id"), F.col("donor_name")], size, page)

    def outside_spending(self, candidate_id: int | None = None) -> DataFrame:
        rows = races.outside_by_candidate(self.spending())
        return rows if candidate_id is None else rows.where(F.col("candidate_id") == candidate_id)

    def races(self) -> DataFrame:
        totals = self.receipts().groupBy("committee_id").agg(F.round(F.sum("amount"), 2).alias("total_amount"))
        return races.race_builder(self.t.candidates, self.t.links, totals, self.spending().where("d2_part LIKE '9%'"))

    def race(self, race_key: str) -> DataFrame:
        return self.races().where(F.col("race_key") == race_key)

    def race_inflow(self, n: int = 5) -> DataFrame:
        rows = self.spending().join(trends.top_keys(self.spending(), "race_key", "amount", n).select("race_key"), "race_key", "left_semi")
        return trends.cumulative(rollups.monthly_totals(rows, ("race_key",), day="expended_date"), "race_key")

    def race_payees(self, n: int = 5) -> DataFrame:
        return races.top_per_group(self.spending(), "race_key", "payee_name", "amount", n)

    # analytics

    def network(self, least: float = 0.0, limit: int = 500) -> DataFrame:
        return self.edges().where(F.col("total_amount") >= least).orderBy(F.desc("total_amount"), "donor_key", "committee_id").limit(limit)

    def anomalies(self) -> DataFrame:
        return anomalies.anomaly_union(self.receipts())

    def concentration(self) -> DataFrame:
        return concentration.concentration(self.edges())

    def time_series(self, months: int = 24) -> DataFrame:
        return trends.time_series(rollups.monthly_totals(self.receipts()), months)

    def geo(self, by: str = "state") -> DataFrame:
        return geography.cities(self.receipts()) if by == "city" else geography.by_place(self.receipts(), (by,))

    def geo_drilldown(self, state: str, size: int = 25, page: int = 1) -> DataFrame:
        return geography.drilldown(self.receipts(), state, size, page)

    def categories(self) -> DataFrame:
        rows = self.spending().withColumn("category", spending_category(F.col("purpose")))
        return rows.groupBy("category").agg(F.round(F.sum("amount"), 2).alias("total_amount"), F.count("*").alias("n"))

    def reconciliation(self, floor: float = 1000.0, n: int = 50) -> DataFrame:
        return filings.recon_outliers(filings.reconcile(self.t.filings, self.t.receipts), floor, n)

    def cogiving(self, donors: int = 800, edges: int = 1200, least: float = 5000.0, shared: int = 2) -> DataFrame:
        return graph.cogiving(self.edges(), self.t.links, donors, edges, least, shared)

    def similarity(self, committees: int = 500, edges: int = 1200, shared: int = 3, least: float = 10_000.0) -> DataFrame:
        return graph.similarity(self.edges(), committees, edges, shared, least)

    def competition(self, candidates: int = 250, edges: int = 1200, shared: int = 2, least: float = 2_500.0) -> DataFrame:
        return graph.competition(self.edges(), self.t.links, candidates, edges, shared, least)

    def risk(self) -> DataFrame:
        recon = filings.mismatch_status(filings.reconcile(self.t.filings, self.t.receipts))
        return federal.entity_risk(recon, anomalies.spikes_present(self.receipts()), anomalies.concentration_flags(self.receipts()))

    def relationships(self, committee_ids: list[int]) -> DataFrame:
        return entities.relationships(self.receipts(), F.col("committee_id").isin(committee_ids))

    def vendor_network(self) -> DataFrame:
        return federal.vendor_network(self.spending())

    def segments(self, k: int = 4, home: str = "NATION_1") -> DataFrame:
        return kernels.segments(kernels.donor_features(self.receipts(), home), k)

    def trace_money(self, donor_key: str, max_hops: int = 3) -> DataFrame:
        """Nodes within 1 to 8 hops of a donor."""
        rows = self.edges().select(F.concat(F.lit("donor:"), "donor_key").alias("src"), F.concat(F.lit("committee:"), F.col("committee_id").cast("string")).alias("dst"), F.col("total_amount").alias("weight"))
        start = self.t.spark.range(1).select(F.lit(f"donor:{donor_key}").alias("node"))
        return graph.hops(rows, start, min(8, max(1, max_hops)))

    def focus(self, committee_id: int, caps: dict[str, int] | None = None) -> DataFrame:
        """Ego network of a committee: donors in, vendors out, capped per type with the rest folded."""
        a = self.edges().where(F.col("committee_id") == committee_id).select(F.lit("donor").alias("edge_type"), F.col("donor_key").alias("src"), F.lit("me").alias("dst"), F.col("total_amount").alias("weight"))
        b = self.spending().where((F.col("committee_id") == committee_id) & vendor_rows()).groupBy("payee_name").agg(F.sum("amount").alias("weight")).select(F.lit("vendor").alias("edge_type"), F.lit("me").alias("src"), F.col("payee_name").alias("dst"), "weight")
        return graph.ego(a.unionByName(b), "me", caps or {"donor": 40, "vendor": 25})

    # organizations of the federal register, lobbying, families

    def orgs527(self, search: str | None = None, size: int = 50, page: int = 1) -> DataFrame:
        rows = org527.latest(self.t.orgs527, [F.desc("org_name"), F.col("zip").desc_nulls_last()]).select("ein", "org_name", "city", "state")
        return directory.directory(rows, search, "org_name", {"name": "org_name"}, "name", "asc", size, page, "ein")

    def ledger527(self, ein: int | None = None) -> DataFrame:
        rows = self.t.spending527 if ein is None else self.t.spending527.where(F.col("ein") == ein)
        return org527.ledger(rows, "recipient_name")

    def rollup527(self) -> DataFrame:
        return org527.rollup(self.t.spending527)

    def dark_money(self) -> DataFrame:
        return org527.dark_money(self.t.spending527)

    def ecosystem527(self, cap: int = 150) -> DataFrame:
        return QUERIES["org527_graph"](self.t.spark, self.t.sf_dir) if cap == 150 else org527.graph(self.t.spending527, QUERIES["match_orgs_committees"](self.t.spark, self.t.sf_dir), QUERIES["match_directors_donors"](self.t.spark, self.t.sf_dir), cap)

    def matches(self, job: str) -> DataFrame:
        """Rows of a matching job: client_donors, client_payees, client_orgs, orgs_committees, recipients, directors_donors, directors_candidates, directors_addresses or org_addresses."""
        return QUERIES[f"match_{job}"](self.t.spark, self.t.sf_dir)

    def families(self) -> DataFrame:
        return families.families(families.strong_pairs(self.t.committee_book, self.t.links, families.officers(self.t.committee_book)))

    def family_review(self) -> DataFrame:
        return families.weak_pairs(self.t.committee_book, self.t.links)

    def federal_local(self) -> DataFrame:
        return QUERIES["federal_local_matches"](self.t.spark, self.t.sf_dir)

    def federal_local_network(self) -> DataFrame:
        return QUERIES["federal_local_network"](self.t.spark, self.t.sf_dir)

    def multilayer(self) -> DataFrame:
        return QUERIES["multilayer_network"](self.t.spark, self.t.sf_dir)

    def person(self, text: str, per_kind: int = 10) -> DataFrame:
        """One name over donors, candidates, directors and clients, nicknames included."""
        kinds = {"donor": (self.t.donor_book, "donor_key", "donor_name"), "candidate": (self.t.candidate_book, "candidate_id", "candidate_name"), "director": (self.t.directors527, "ein", "person_name"), "client": (self.t.lobby_clients, "client_id", "client_name")}
        out = None
        for kind, (rows, key, name) in kinds.items():
            found = rows.where(name_matches(F.col(name), text)).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.col(name).alias("name")).distinct().orderBy("name", "key").limit(per_kind)
            out = found if out is None else out.unionByName(found)
        return out

    # search

    def search(self, text: str, per_kind: int = 10) -> DataFrame:
        return directory.site_search(
            {"candidate": (self.t.candidates, "candidate_id", "candidate_name"), "committee": (self.t.committees, "committee_id", "committee_name"), "donor": (self.t.receipts, "donor_key", "donor_name"), "payee": (self.t.expenditures, "payee_name", "payee_name")}, text, per_kind
        )

    def suggest(self, text: str, n: int = 10) -> DataFrame:
        return self.t.committees.where(name_matches(F.col("committee_name"), text)).orderBy("committee_name", "committee_id").limit(n)

    def live_feed(self, n: int = 100) -> DataFrame:
        return self.receipts().where("received_date IS NOT NULL").orderBy(F.desc("received_date"), F.desc("amount"), "filing_id").limit(n)

    def compare(self, left: int, right: int) -> DataFrame:
        return entities.compare(self.receipts(), F.col("committee_id") == left, F.col("committee_id") == right)

    def vendors(self, search: str | None = None, size: int = 50, page: int = 1) -> DataFrame:
        rows = rollups.recipient_summary(self.spending())
        return directory.directory(rows, search, "recipient_name", {"amount": "total_amount", "name": "recipient_name"}, "amount", "desc", size, page, "recipient_key")

    def freshness(self, today: date) -> DataFrame:
        from ledgerlens.sources.sinks import freshness

        return freshness(self.t.receipts, "received_date", today.isoformat(), 30)


#: Paths and the endpoint that answers them.
ROUTES = {
    "/api/stats": "stats", "/api/committees": "committees", "/api/committees/<id>": "committee", "/api/donors": "donors", "/api/donors/<key>": "donor", "/api/reports": "reports", "/api/reports/<id>": "filing",
    "/api/analytics/network": "network", "/api/analytics/anomalies": "anomalies", "/api/analytics/concentration": "concentration", "/api/analytics/time-series": "time_series", "/api/analytics/geo": "geo",
    "/api/analytics/nlp": "categories", "/api/analytics/reconciliation": "reconciliation", "/api/analytics/donor-cogiving": "cogiving", "/api/analytics/committee-similarity": "similarity",
    "/api/analytics/candidate-competition": "competition", "/api/analytics/network/suggest": "suggest", "/api/analytics/network/focus-sankey": "focus",
    "/analytics/state-races/": "races", "/analytics/state-races/<key>": "race", "/analytics/risk": "risk", "/analytics/relationships": "relationships", "/analytics/geo-drilldown": "geo_drilldown",
    "/candidates/": "candidates", "/candidates/<id>": "candidate", "/candidates/<id>/outside-spending": "outside_spending", "/candidate-finance/itemized": "candidate_itemized",
    "/committees/<id>/donors": "committee_donors", "/committees/<id>/payees": "committee_payees", "/committees/<id>/filings": "committee_filings",
    "/viz-lab/cumulative-inflow": "race_inflow", "/viz-lab/payee-dominance": "race_payees", "/federal/trace-money": "trace_money", "/federal/donor-intelligence": "segments",
    "/irs527/": "orgs527", "/irs527/<ein>/ledger": "ledger527", "/irs527/rollup": "rollup527", "/irs527/dark-money": "dark_money", "/api/analytics/irs527-ecosystem": "ecosystem527",
    "/matches/<job>": "matches", "/committees/families": "families", "/committees/families/review": "family_review", "/federal/local-matches": "federal_local",
    "/federal/local-network": "federal_local_network", "/federal/multilayer": "multilayer", "/person": "person",
    "/search": "search", "/live-feed": "live_feed", "/compare": "compare", "/vendors": "vendors", "/vendors/network": "vendor_network", "/data-status": "freshness",
}


def call(api: Api, path: str, **parameters) -> DataFrame:
    """The answer of a path."""
    return getattr(api, ROUTES[path])(**parameters)
