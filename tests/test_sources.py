"""Readers, sinks, kernels and streams on small files."""

import shutil
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import kernels
from ledgerlens.sources import readers, sinks
from ledgerlens.streaming import events


def test_expenditures_with_rejects(spark, tmp_path):
    (tmp_path / "exp.txt").write_text("CommitteeID\tPayeeName\tAmount\tExpendedDate\tD2Part\tSupporting\tOpposing\n1\tA\t$10.00\t01/02/2020\t6A\tFalse\tFalse\n2\tB\tx\t01/02/2020\t6A\tFalse\tFalse\n3\tC\t5\t01/02/2020\t1A\tFalse\tFalse\n4\tD\t5\t01/02/2020\t9A\tTrue\tTrue\n")
    kept, bad = readers.read_expenditures(spark, str(tmp_path / "exp.txt"))
    assert [(r["committee_id"], r["amount"], str(r["expended_date"])) for r in kept.collect()] == [(1, 10.0, "2020-01-02")]
    assert {r["committee_id"]: r["reject_reason"] for r in bad.collect()} == {2: "bad_amount", 3: "unknown_part", 4: "supports_and_opposes"}


def test_records_and_latest(spark, tmp_path):
    (tmp_path / "a1.txt").write_text("H|x|y\n1|f|11|Org|St|IL\n1|f|22|Org|St|NY\nA|f|11|n|5|d\nA|f|22|n|5|d\nA|short\nZ|1|2\n")
    records = readers.read_records(spark, str(tmp_path / "a1.txt"))
    assert records.where("bad").count() == 2
    assert sorted(r["record_type"] for r in readers.records_for_state(records, "IL").collect()) == ["1", "A"]
    assert readers.latest_file(spark, str(tmp_path), "a").endswith("a1.txt") and readers.latest_file(spark, str(tmp_path), "zz") is None


def test_json_html_census(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"id": 1, "v": 1}\n{"id": 1, "v": 2}\n{"id": 2, "v": 1}\n')
    assert sorted((r["id"], r["v"]) for r in readers.read_json_pages(spark, str(tmp_path / "p.json"), "id long, v long", "id", "v").collect()) == [(1, 2), (2, 1)]
    pages = spark.createDataFrame([(1, "<table><tr><th>A</th></tr><tr><td>x <b>y</b></td><td>2</td></tr></table>"), (2, None)], "page_id long, html string")
    assert [(r["row"], r["cells"]) for r in readers.html_table(pages).collect()] == [(0, ["A"]), (1, ["x y", "2"])]
    census = {r["column"]: r for r in sinks.census(spark.createDataFrame([("a", 1), ("", None)], "s string, n int")).collect()}
    assert census["s"]["filled"] == 1 and census["n"]["fill_rate"] == 0.5


def test_sinks_and_guards(spark, tmp_path):
    df = spark.range(10).withColumn("k", F.col("id") % 2)
    sinks.write_table(df, str(tmp_path / "t"), ("k",))
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_json(df, str(tmp_path / "j"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert sinks.fingerprint(back.select("id", F.col("k").cast("long").alias("k"))) == sinks.fingerprint(df.repartition(3))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == spark.read.json(str(tmp_path / "j")).count() == 10
    assert sinks.guard_row_count(df, 11) == 10
    with pytest.raises(sinks.LoadRefused):
        sinks.guard_row_count(df, 20)
    diff = {r["change"]: r["n"] for r in sinks.snapshot_diff(df, df.where("id < 8").withColumn("k", F.when(F.col("id") == 1, 9).otherwise(F.col("k"))), ["id"]).collect()}
    assert diff == {"same": 7, "changed": 1, "removed": 2}


def test_streams_match_batch(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1 + i % 5, i % 24, (7 * i) % 60), i % 4, "ab"[i % 2], float(i), "{}") for i in range(200)]
    table = spark.createDataFrame(sorted(rows, key=lambda r: r[1]), events.SCHEMA)
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.read_stream(spark, str(tmp_path / "in"))
    for name, f in (("tumbling", events.tumbling), ("sessions", events.sessions)):
        query = f(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name == "tumbling" else "append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        query.awaitTermination(120)
        got, expect = {tuple(r) for r in spark.table(name).collect()}, {tuple(r) for r in f(table).collect()}
        assert got == expect if name == "tumbling" else got <= expect and len(expect) - len(got) <= 8
    twice = str(tmp_path / "twice")
    shutil.copytree(tmp_path / "in", twice)
    table.coalesce(1).write.mode("append").parquet(twice)
    events.write(events.deduped(events.read_stream(spark, twice)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200


def test_kernels(spark):
    x = np.array([[0.0, 0], [0, 1], [10, 10], [10, 11], [50, 50]])
    assert kernels.kmeans(x, 2).tolist() == [0, 0, 0, 0, 1]
    assert kernels.dbscan(x, 1.5, 2).tolist() == [0, 0, 1, 1, -1]
    assert kernels.standardize(np.array([[1.0], [1.0]])).tolist() == [[0.0], [0.0]]
    two = [("a", "b", 5.0), ("b", "c", 5.0), ("a", "c", 5.0), ("d", "e", 5.0), ("e", "f", 5.0), ("d", "f", 5.0), ("c", "d", 0.5)]
    edges = spark.createDataFrame(two, "src string, dst string, weight double")
    groups = {r["node"]: r["community"] for r in kernels.louvain(edges).collect()}
    assert groups["a"] == groups["b"] == groups["c"] != groups["d"] == groups["e"] == groups["f"]
    labels = {r["node"]: r["cluster"] for r in kernels.label_propagation(edges).collect()}
    assert labels["a"] == labels["b"] == labels["c"] and labels["d"] == labels["e"] == labels["f"]
    between = {r["node"]: r["betweenness"] for r in kernels.betweenness(edges).collect()}
    assert between["c"] == between["d"] > between["a"] == 0


def test_local_entities(spark):
    person = "donor_key string, donor_name string, full_name string, total_amount double, address string, city string, state string, zip string, employer string, occupation string"
    rows = [
        ("k1", "Ann Lee", "ann lee", 5.0, "1 main st", "Aurora", "IL", "60505", "Acme Steel", "clerk"), ("k2", "Ann  Lee", "ann lee", 9.0, "1 main st", "Aurora", "IL", "60505", "Acme Steel", "clerk"),
        ("k3", "Ann Lee", "ann lee", 1.0, "9 far rd", "Miami", "FL", "33101", None, None), ("k4", "Bo Fox", "bo fox", 1.0, None, None, None, None, None, None), ("k5", "No Name", None, 1.0, None, None, None, None, None, None),
    ]
    got = {r["donor_key"]: r for r in kernels.local_entities(spark.createDataFrame(rows, person)).collect()}
    assert set(got) == {"k1", "k2", "k3", "k4", "k5"}
    assert got["k1"]["entity_id"] == got["k2"]["entity_id"] != got["k3"]["entity_id"] and got["k1"]["display_name"] == "Ann  Lee" and got["k1"]["status"] == "auto"


def test_feeds(spark, tmp_path):
    from datetime import date

    from ledgerlens.sources import feeds

    (tmp_path / "r.txt").write_text(
        "ID\tCommitteeID\tFiledDocID\tETransID\tLast\tFirst\tRcvDate\tAmount\tAgg\tLoan\n"
        + "1\t7\t3\tx1\t  Lee \tAnn\t1/2/2024\t$1,000.50\t\tbad\n" + "oops\t7\t3\n" + "2\t\t\t\t\t\tnever\t(5.00)\t1\t2\n"
    )
    rows, bad = feeds.load_feed(spark, str(tmp_path / "r.txt"), "Receipts")
    got = {r["id"]: r for r in rows.collect()}
    assert rows.columns == feeds.LAYOUTS["Receipts"].split() and set(got) == {1, 2} and bad.first()["reject_reason"] == "missing_id"
    assert (got[1]["last_name"], got[1]["received_date"], got[1]["amount"], got[1]["loan_amount"], got[1]["archived"]) == ("Lee", date(2024, 1, 2), 1000.5, None, False)
    assert (got[2]["received_date"], got[2]["amount"], got[2]["committee_id"]) == (None, -5.0, None)
    assert feeds.kinds("FiledDocs")["reporting_period_end"] == "date" and "received_at" not in feeds.kinds("FiledDocs") and feeds.kinds("D2Totals")["total_receipts"] == "money"
    person = ", ".join(f"{c} string" for c in "last_name first_name title".split())
    current = spark.createDataFrame([(1, "Lee", "Ann", "Chair")], f"id long, {person}")
    previous = spark.createDataFrame([(9, 5, "Fox", "Bo", "Chair", date(2020, 1, 1))], f"id long, committee_id long, {person}, resign_date date")
    links = spark.createDataFrame([(1, 5), (1, 6)], "officer_id long, committee_id long")
    found = sorted((r["id"], r["committee_id"], r["is_current"]) for r in feeds.attach_officer_committees(current, previous, links).collect())
    assert found == [(1, 5, True), (1, 6, True), (9, 5, False)]


def test_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from ledgerlens.sources import shared

    df = shared.materialize(spark.range(3), "t")
    assert shared.exists(df) and df.count() == 3
    shared.discard(df)
    assert not shared.exists(df)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://x:7077"))
    with pytest.raises(ValueError):
        shared.shared_dir(session)
    session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        shared.shared_dir(session)


def test_stored_view_follows_its_tables(spark, tmp_path):
    from ledgerlens.plans.catalog import Tables

    for n, rows, schema in (("lineitem", [(1, 2, 3, 1, 5.0, 10.0, 0.0, 0.0, "A", "F", "1999-01-02")], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string"), ("part", [(2, "small ring", "Brand#1", "PROMO", 3, 1.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{n}.parquet"))
    t = Tables(spark, str(tmp_path))
    assert t.expenditures.count() == 1 and t.expenditures._ledgerlens_path == t.expenditures._ledgerlens_path
    spark.createDataFrame([(9, 2, 3, 1, 5.0, 10.0, 0.0, 0.0, "A", "F", "1999-01-02")] * 2, spark.read.parquet(str(tmp_path / "lineitem.parquet")).schema).write.mode("append").parquet(str(tmp_path / "lineitem.parquet"))
    assert t.expenditures.count() == 3
