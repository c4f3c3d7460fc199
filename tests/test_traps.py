"""Readings that silently change numbers, on small planted tables."""

from datetime import date

from pyspark.sql import functions as F

from ledgerlens.functions import names, predicates, text
from ledgerlens.operators import anomalies, concentration, entities, filings, graph, matching, races, rollups, trends


def test_two_percentile_rules(spark):
    df = spark.createDataFrame([(float(x),) for x in range(100)], "amount double")
    assert rollups.floor_rank(df, "amount", 0.95).first()["value"] == 94.0
    assert abs(rollups.interpolated(df, "amount", 0.95).first()["value"] - 94.05) < 1e-9
    ties = spark.createDataFrame([(1.0,)] * 10 + [(7.0,)] * 3, "amount double")
    assert rollups.floor_rank(ties, "amount", 0.5).first()["value"] == 1.0


def test_receipt_predicates_differ(spark):
    rows = [("blank", 5.0, "", False), ("null", 5.0, None, False), ("one", 5.0, "1A", False), ("two", 5.0, "2A", False), ("unknown", 5.0, "1A", None), ("gone", 5.0, "1A", True), ("zero", 0.0, "1A", False)]
    df = spark.createDataFrame(rows, "k string, amount double, d2_part string, archived boolean")
    keys = lambda c: {r["k"] for r in df.where(c).collect()}
    assert keys(predicates.contributions()) == {"blank", "null", "one", "unknown"}
    assert keys(predicates.all_receipts()) == {"blank", "null", "one", "two", "unknown"}
    assert keys(predicates.entity_receipts()) == {"one", "unknown"}
    assert keys(predicates.current_native()) == {"blank", "null", "one", "two", "zero"}
    assert keys(predicates.vendor_rows()) == {"blank", "null", "one", "two", "unknown", "gone", "zero"}


def test_cycles_and_scopes(spark):
    days = spark.createDataFrame([(date(y, 6, 1),) for y in (1997, 1998, 1999)] + [(None,)], "d date")
    assert [r[0] for r in days.select(predicates.cycle(F.col("d"))).collect()] == [1998, 1998, 2000, None]
    scope = predicates.Scope.of_cycle(1999)
    assert (scope.low, scope.high) == (date(1999, 1, 1), date(2000, 12, 31)) and scope.whole_cycles() and scope.cycles() == [2000]
    assert days.where(scope.where("d")).count() == 1 and days.where(predicates.Scope().where("d")).count() == 4
    assert predicates.Scope(date(1999, 3, 4), date(2000, 2, 1)).snapped().high == date(2000, 12, 31)


def receipts(spark, rows):
    return spark.createDataFrame(rows, "committee_id long, donor_key string, donor_name string, amount double, received_date date")


def test_two_spike_rules(spark):
    day = lambda m: date(2020, m, 3)
    rows = [(1, "d", "D", 1000.0, day(m)) for m in (1, 2, 3)] + [(1, "d", "D", 9000.0, day(6))] + [(2, "d", "D", 1000.0, day(1)), (2, "d", "D", 9000.0, day(2))]
    df = receipts(spark, rows)
    present = {(r["committee_id"], r["month"]) for r in anomalies.spikes_present(df).collect()}
    filled = {(r["committee_id"], r["month"]) for r in anomalies.spikes_zero_filled(df).collect()}
    assert present == {(1, "2020-06")}
    assert filled == {(1, "2020-06"), (2, "2020-02")}
    covered = spark.createDataFrame([(1, date(2020, 3, 31))], "committee_id long, covered_through date")
    assert anomalies.spikes_present(df, covered=covered).count() == 0
    months = {r["month"]: r["total_amount"] for r in anomalies.zero_filled_months(rollups.monthly_totals(df, ("committee_id",)), "committee_id").where("committee_id = 1").collect()}
    assert months == {"2020-01": 1000.0, "2020-02": 1000.0, "2020-03": 1000.0, "2020-04": 0.0, "2020-05": 0.0, "2020-06": 9000.0}


def test_concentration(spark):
    edges = spark.createDataFrame([(1, "a", 50.0), (1, "b", 30.0), (1, "c", 20.0), (1, "d", -5.0), (2, "a", 10.0)], "committee_id long, donor_key string, total_amount double")
    got = {r["committee_id"]: r for r in concentration.concentration(edges).collect()}
    assert got[1]["hhi"] == 3800.0 and got[1]["donor_count"] == 3 and got[1]["top1_share"] == 0.5 and got[1]["gini"] == 0.2
    assert got[2]["hhi"] == 10000.0 and got[2]["gini"] == 0.0


def test_undated_rows(spark):
    df = receipts(spark, [(1, "a", "A", 5.0, None), (1, "a", "B", 7.0, date(2019, 1, 1)), (1, " ", "C", 1.0, date(2019, 1, 1))])
    assert rollups.donor_committee(df).first()["total_amount"] == 12.0
    cycle = rollups.donor_cycle_summary(df).collect()
    assert [(r["cycle"], r["total_amount"]) for r in cycle] == [(2020, 7.0)]
    assert {r["cycle"] for r in trends.cycle_totals(df, ("committee_id",)).collect()} == {None, 2020}


def test_filing_pick_and_condensation(spark):
    rows = [
        (1, 10, date(2020, 3, 31), date(2020, 4, 1), 5), (2, 10, date(2020, 3, 31), date(2020, 5, 1), None), (3, 10, date(2020, 6, 30), None, 7),
        (4, 10, date(2020, 6, 30), date(2020, 7, 1), 8), (5, 10, None, date(2021, 1, 1), 9),
    ]
    df = spark.createDataFrame(rows, "filing_id long, committee_id long, period_end date, received_on date, d2_id long").withColumn("doc_type", F.lit("D2"))
    live = {r["period_end"]: r["filing_id"] for r in filings.live_filings(df).collect()}
    assert live == {date(2020, 3, 31): 1, date(2020, 6, 30): 4, None: 5}
    latest = filings.most_recent_filing(df)
    assert latest.first()["filing_id"] == 4
    items = spark.createDataFrame([(1, 10, 1.0, date(2020, 3, 1)), (1, 10, 1.0, date(2020, 3, 1)), (2, 10, 2.0, date(2020, 3, 2)), (9, 10, 3.0, date(2020, 8, 1)), (9, 11, 4.0, date(2019, 1, 1))], "filing_id long, committee_id long, amount double, received_date date")
    kept = sorted(r["amount"] for r in filings.condense(items, latest, filings.live_filings(df), "received_date", True).collect())
    assert kept == [1.0, 3.0, 4.0]
    assert sorted(r["amount"] for r in filings.condense(items, latest, filings.live_filings(df), "received_date", False).collect()) == [1.0, 3.0]


def test_race_totals_count_a_committee_once(spark):
    candidates = spark.createDataFrame([(1, "r"), (2, "r"), (3, "q")], "candidate_id long, race_key string")
    links = spark.createDataFrame([(7, 1), (7, 2), (8, 3)], "committee_id long, candidate_id long")
    totals = spark.createDataFrame([(7, 60.0), (7, 40.0), (8, 10.0)], "committee_id long, total_amount double")
    outside = spark.createDataFrame([(1, 25.0)], "candidate_id long, amount double")
    got = {r["race_key"]: r for r in races.race_builder(candidates, links, totals, outside).collect()}
    assert got["r"]["money"] == 100.0 and got["r"]["outside"] == 25.0 and got["r"]["pressure"] == 0.25 and got["q"]["money"] == 10.0


def test_named_people(spark):
    df = spark.createDataFrame([("Smith, Ann",), ("Ann Smith and Bo Lee",), ("Ann Smith; Jr; ann smith",), (None,), ("Ann Smith / Bo Lee/Cy Poe",)], "n string")
    got = [r[0] for r in df.select(text.people(F.col("n"))).collect()]
    assert got == [["ann smith"], ["ann smith", "bo lee"], ["ann smith"], [], ["ann smith", "bo lee", "cy poe"]]
    people = spark.createDataFrame([(1, "Ann B. Smith Jr"), (2, "Bo Lee")], "candidate_id long, candidate_name string")
    rows = spark.createDataFrame([(5, "Ann Smith; Bo Lee; No One", 30.0)], "row_id long, n string, amount double")
    assert sorted((r["candidate_id"], r["share"], r["named"]) for r in races.attribute_named(rows, "n", "amount", people).collect()) == [(1, 10.0, 3), (2, 10.0, 3)]


def test_parsers(spark):
    df = spark.createDataFrame([("$1,234.50",), ("(12.00)",), ("-3",), ("n/a",), (None,), ("5/6/2020 $7.25",)], "c string")
    assert [r[0] for r in df.select(text.parse_amount(F.col("c"))).collect()] == [1234.5, -12.0, -3.0, None, None, 7.25]
    days = spark.createDataFrame([("2020-01-02",), ("01/02/2020",), ("20200102",), ("paid 1/2/2020 late",), ("never",), (None,), ("Jan 2, 2020",)], "c string")
    assert [r[0] for r in days.select(text.parse_date(F.col("c"))).collect()] == [date(2020, 1, 2)] * 4 + [None, None, date(2020, 1, 2)]
    urls = spark.createDataFrame([("HTTPS://www.Site.org/A/b/?q=1#x",), ("m.site.org",)], "c string")
    assert [r[0] for r in urls.select(text.canonical_url(F.col("c"))).collect()] == ["site.org/A/b", "site.org"]


def test_similarity(spark):
    df = spark.createDataFrame([(1, "word"), (2, "words"), (3, None), (4, "")], "id long, t string")
    grams = {r["id"]: r["g"] for r in df.select("id", text.trigrams(F.col("t")).alias("g")).collect()}
    assert grams[1] == ["  w", " wo", "wor", "ord", "rd "] and grams[3] == grams[4] == []
    pairs = [tuple(r) for r in matching.trigram_pairs(df, "id", "t", 0.3).collect()]
    assert pairs == [(1, 2, round(4 / 7, 4))]


def test_overlap_join_is_exact(spark):
    import random

    rng = random.Random(1)
    a = [(i, sorted({rng.choice("abcdefghij") for _ in range(rng.randint(0, 6))})) for i in range(60)]
    b = [(i, sorted({rng.choice("abcdefghij") for _ in range(rng.randint(0, 6))})) for i in range(60)]
    left, right = spark.createDataFrame(a, "left_id long, tokens array<string>"), spark.createDataFrame(b, "right_id long, tokens array<string>")
    for least in (0.3, 0.5, 0.8, 1.0):
        got = {(r[0], r[1]) for r in matching.overlap_join(left, right, least).collect()}
        assert got == {(i, j) for i, x in a for j, y in b if x and y and len({*x} & {*y}) / len({*x} | {*y}) >= least}


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("d", "e", 1.0)], "src string, dst string, weight double")
    assert {r["node"]: r["component"] for r in graph.components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    start = spark.createDataFrame([("a",)], "node string")
    assert {r["node"]: r["hop"] for r in graph.hops(edges, start, 5).collect()} == {"a": 0, "b": 1, "c": 2}
    ranks = {r["node"]: r["rank"] for r in graph.pagerank(edges).collect()}
    near = {"a": {"b": 1.0}, "b": {"a": 1.0, "c": 2.0}, "c": {"b": 2.0}, "d": {"e": 1.0}, "e": {"d": 1.0}}
    x = dict.fromkeys(near, 0.2)
    for _ in range(25):
        x = {n: 0.15 / 5 + 0.85 * sum(x[m] * near[m][n] / sum(near[m].values()) for m in near[n]) for n in near}
    top = max(x.values())
    assert all(abs(ranks[n] - x[n] / top) < 1e-5 for n in x)


def test_names_and_profiles(spark):
    df = spark.createDataFrame([(1, "b", 1.0), (1, "a", 5.0), (1, "b", 1.0), (1, "c", 5.0)], "k long, n string, amount double")
    r = df.groupBy("k").agg(names.name_max("n").alias("x"), names.name_min("n").alias("y"), names.name_mode("n").alias("z")).first()
    assert (r["x"], r["y"], r["z"]) == ("c", "a", "b") and names.top_variant(df, "k", "n", "amount").first()["n"] == "a"
    rows = [(1, "Acme Fund", "1 Main", None), (2, "Acme  fund", "1 Main", None), (3, "Other Group", None, "x"), (4, "Quite Different", None, "x"), (5, "Lone", None, None)]
    frame = spark.createDataFrame(rows, "id long, name string, address string, shared_id string")
    assert {r["id"]: r["profile"] for r in entities.resolve_profiles(frame, merge=0.85).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert {r["id"]: r["profile"] for r in entities.resolve_profiles(frame).collect()} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5}  # .85 is for review, not merged
