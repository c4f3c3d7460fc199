"""Streaming windows (batch form) and load-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.plans.catalog import query
from ledgerlens.sources import readers, sinks
from ledgerlens.streaming import events


def _plain(df):
    """Timestamps without a zone, as the oracle has them."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if k == "timestamp" else F.col(c) for c, k in df.dtypes])


@query("events_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def _(t):
    return _plain(events.tumbling(t.events))


@query("events_sliding", "SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS w FROM events) GROUP BY ALL")
def _(t):
    return _plain(events.sliding(t.events).withColumn("window_start", F.col("window_start")))


@query("events_session", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS head FROM events), s AS (SELECT *, sum(head) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, sid")
def _(t):
    return _plain(events.sessions(t.events))


@query("events_dedupe", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def _(t):
    return events.deduped(t.events.unionByName(t.events)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("events_json", "SELECT (props->>'$.k')::BIGINT AS k, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(F.get_json_object("props", "$.k").try_cast("bigint").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("schema_census")
def _(t):
    return sinks.census(t.documents)


@query("freshness", "SELECT max(received_date) AS latest, datediff('day', max(received_date), DATE '2001-12-31') AS age_days, datediff('day', max(received_date), DATE '2001-12-31') > 30 AS stale FROM receipts")
def _(t):
    return sinks.freshness(t.receipts, "received_date", "2001-12-31", 30).withColumn("age_days", F.col("age_days").cast("long"))


@query("snapshot_diff", "SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'removed' WHEN o_orderkey % 50 = 1 THEN 'changed' ELSE 'same' END AS change, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    old = t.orders.select("o_orderkey", "o_totalprice")
    new = old.where("o_orderkey % 50 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 50 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return sinks.snapshot_diff(old, new, ["o_orderkey"])


@query("expenditure_rejects", "SELECT CASE WHEN d2_part IS NULL THEN 'unknown_part' WHEN amount > 90000 THEN 'extreme_amount' END AS reject_reason, count(*) AS n FROM expenditures WHERE d2_part IS NULL OR amount > 90000 GROUP BY 1")
def _(t):
    rules = [("unknown_part", F.col("d2_part").isNull()), ("extreme_amount", F.col("amount") > 90000)]
    return readers.split_rejects(t.expenditures, rules)[1].groupBy("reject_reason").agg(F.count("*").alias("n"))


@query("html_list_items", "SELECT page_id, len(regexp_extract_all(html, '<li[^>]*>(.*?)</li>', 1)) AS items FROM pages")
def _(t):
    items = F.regexp_extract_all("html", F.lit(r"<li[^>]*>(.*?)</li>"), F.lit(1))
    return t.pages.select("page_id", F.size(items).cast("long").alias("items"))
