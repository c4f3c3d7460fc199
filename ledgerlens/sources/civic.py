"""Civic tables over the synthetic star schema.

Operators take their column names as parameters. These views give the synthetic tables the columns of filing data, so that
the same operators run on both. Each view is one SQL text over table placeholders, used by Spark and by the DuckDB oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.sources.shared import discard, exists, materialize

#: Receipts: one row per itemized contribution. Part 1 individual, 2 transfer, blank unknown; null `archived` counts as current in shared filters.
RECEIPTS = """
SELECT l.l_orderkey AS filing_id, l.l_suppkey AS committee_id, s.s_name AS committee_name, c.c_custkey AS donor_id, c.c_name AS donor_name,
       lower(trim(concat(c.c_name, '|', c.c_mktsegment, '|', n.n_name))) AS donor_key,
       concat('City ', cast(c.c_custkey % 11 AS VARCHAR(10))) AS city, n.n_name AS state, r.r_name AS region, c.c_mktsegment AS occupation,
       l.l_extendedprice AS amount, CASE WHEN l.l_linenumber = 7 AND l.l_quantity > 45 THEN NULL ELSE cast(l.l_shipdate AS DATE) END AS received_date,
       cast(o.o_orderdate AS DATE) AS filed_date,
       CASE l.l_returnflag WHEN 'N' THEN '1A' WHEN 'A' THEN '2A' ELSE NULL END AS d2_part,
       CASE WHEN l.l_linestatus = 'F' AND l.l_quantity < 10 THEN TRUE WHEN l.l_linenumber = 6 THEN NULL ELSE FALSE END AS archived
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""
#: Expenditures: payee, purpose (some null), part 6 to 9, a flag for odd amounts (null counts as fine) and the named candidate with support or oppose flags.
EXPENDITURES = """
SELECT l.l_orderkey AS filing_id, l.l_suppkey AS committee_id, p.p_name AS payee_name,
       CASE p.p_partkey % 14 WHEN 0 THEN 'CONTRIBUTION' WHEN 1 THEN 'Radio advertising' WHEN 2 THEN 'Consulting fees' WHEN 3 THEN 'Payroll salary' WHEN 4 THEN 'Fundraising event'
         WHEN 5 THEN 'Office rent' WHEN 6 THEN 'Legal filing' WHEN 7 THEN 'Travel and hotel' WHEN 8 THEN 'Printing, mail' WHEN 9 THEN NULL WHEN 10 THEN 'TV Media buy'
         WHEN 11 THEN 'Contribution to a committee' WHEN 12 THEN ' ' ELSE concat(p.p_type, ' ', p.p_name) END AS purpose,
       CASE WHEN l.l_quantity > 49 THEN TRUE WHEN l.l_linenumber = 5 THEN NULL ELSE FALSE END AS anomalous,
       p.p_partkey AS candidate_id, p.p_brand AS race_key, l.l_extendedprice AS amount, cast(l.l_shipdate AS DATE) AS expended_date,
       CASE l.l_linenumber % 5 WHEN 0 THEN '6A' WHEN 1 THEN '7A' WHEN 2 THEN '8A' WHEN 3 THEN '9A' ELSE NULL END AS d2_part,
       l.l_returnflag = 'A' AS supporting, l.l_returnflag = 'R' AS opposing, l.l_linestatus = 'F' AND l.l_quantity < 10 AS archived
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
"""
#: Filings: amendments of a period are later rows with the same filer and period end.
FILINGS = """
SELECT o_orderkey AS filing_id, o_custkey AS committee_id, cast(date_trunc('quarter', o_orderdate) AS DATE) AS period_end, cast(o_orderdate AS DATE) AS received_on,
       o_totalprice AS total_receipts, o_orderstatus = 'F' AS archived, o_orderpriority AS doc_type,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderkey END AS d2_id
FROM {orders}
"""
#: Candidates, by race; committees are linked to the candidates whose items they ship in bulk.
CANDIDATES = "SELECT p_partkey AS candidate_id, p_name AS candidate_name, p_brand AS race_key, p_type AS office, p_size % 3 AS party FROM {part}"
LINKS = "SELECT DISTINCT l_suppkey AS committee_id, l_partkey AS candidate_id FROM {lineitem} WHERE l_quantity >= 48"
COMMITTEES = "SELECT s_suppkey AS committee_id, s_name AS committee_name, s_nationkey AS nation_id, s_acctbal AS funds FROM {supplier}"

#: Names for matching: words of a part, in the spellings of four registers. The number keeps equal names few.
_NAME = "{p}.p_name, ' ', {p}.p_type, ' ', cast({p}.p_partkey % 50 AS VARCHAR(10))"
_P, _Q = _NAME.format(p="p"), _NAME.format(p="q")
LOBBY_CLIENTS = f"SELECT c.c_custkey AS client_id, concat(upper(p.p_name), ' ', p.p_type, ' ', cast(p.p_partkey % 50 AS VARCHAR(10)), ', LLC') AS client_name FROM {{customer}} c JOIN {{part}} p ON p.p_partkey = c.c_custkey"
LOBBY_ENTITIES = f"SELECT s.s_suppkey AS entity_id, concat('The ', {_P}, ' Group') AS entity_name FROM {{supplier}} s JOIN {{part}} p ON p.p_partkey = s.s_suppkey + 3"
PAYEE_BOOK = f"SELECT DISTINCT concat({_P}) AS payee_name, l.l_suppkey AS committee_id FROM {{lineitem}} l JOIN {{part}} p ON l.l_partkey = p.p_partkey"
_PLACE = "concat('City ', cast({k} % 11 AS VARCHAR(10))) AS {pre}city, n.n_name AS {pre}state, CASE WHEN {k} % 6 = 5 THEN NULL ELSE concat(cast(60000 + {k} % 37 AS VARCHAR(10)), '-0001') END AS {pre}zip"
DONOR_BOOK = f"SELECT lower(c.c_name) AS donor_key, concat({_P}) AS donor_name, c.c_acctbal * 100 AS total_amount, {_PLACE.format(k='c.c_custkey', pre='')} FROM {{customer}} c JOIN {{part}} p ON p.p_partkey = c.c_custkey JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey"
COMMITTEE_BOOK = f"SELECT s.s_suppkey AS committee_id, concat('Committee for ', {_P}) AS committee_name, concat(cast(s.s_suppkey % 9 AS VARCHAR(10)), ' Main St.') AS street, p.p_brand AS officer, {_PLACE.format(k='s.s_suppkey', pre='')} FROM {{supplier}} s JOIN {{part}} p ON p.p_partkey = s.s_suppkey JOIN {{nation}} n ON s.s_nationkey = n.n_nationkey"
#: Organizations of the federal register: some filer numbers stand under two spellings; four addresses each.
ORGS527 = f"""
SELECT s.s_suppkey AS ein, CASE WHEN v.spelling = 1 THEN concat({_P}, ' Political Action Fund') ELSE concat('The ', {_P}, ' East PAC') END AS org_name,
       {_PLACE.format(k='s.s_suppkey', pre='')}, {_PLACE.format(k='(s.s_suppkey * 3)', pre='custodian_')}, {_PLACE.format(k='(s.s_suppkey * 5 + 1)', pre='contact_')}, {_PLACE.format(k='(s.s_suppkey * 7 + 2)', pre='business_')}
FROM {{supplier}} s JOIN {{part}} p ON p.p_partkey = s.s_suppkey JOIN {{nation}} n ON s.s_nationkey = n.n_nationkey CROSS JOIN (SELECT 1 AS spelling UNION ALL SELECT 2) v
"""
DIRECTORS527 = f"SELECT s.s_suppkey AS ein, concat({_P}, ' Fund') AS org_name, concat({_Q}) AS person_name, {_PLACE.format(k='q.p_partkey', pre='')} FROM {{supplier}} s JOIN {{part}} p ON p.p_partkey = s.s_suppkey JOIN {{part}} q ON q.p_partkey = s.s_suppkey * 3 + 1 JOIN {{nation}} n ON s.s_nationkey = n.n_nationkey"
SPENDING527 = f"SELECT l.l_suppkey AS ein, concat('Org ', cast(l.l_suppkey AS VARCHAR(10))) AS org_name, CASE WHEN l.l_returnflag = 'R' THEN concat({_P}, ' East') ELSE concat({_P}) END AS recipient_name, CASE WHEN l.l_linestatus = 'F' THEN 'IL' ELSE 'WI' END AS state, l.l_extendedprice AS amount, cast(l.l_shipdate AS DATE) AS paid_on FROM {{lineitem}} l JOIN {{part}} p ON l.l_partkey = p.p_partkey"
CANDIDATE_BOOK = f"SELECT p.p_partkey AS candidate_id, CASE WHEN p.p_size % 2 = 0 THEN 'state' ELSE 'federal' END AS register, concat({_P}) AS candidate_name FROM {{part}} p"

FEDERAL_DONORS = f"SELECT concat('F', cast(c.c_custkey AS VARCHAR(10))) AS federal_key, upper(concat({_P})) AS federal_name, round(c.c_acctbal * 40, 2) AS federal_total, concat('City ', cast((c.c_custkey + c.c_custkey % 2) % 11 AS VARCHAR(10))) AS city, n.n_name AS state, concat(cast(60000 + c.c_custkey % 37 + c.c_custkey % 3 AS VARCHAR(10)), '') AS zip FROM {{customer}} c JOIN {{part}} p ON p.p_partkey = c.c_custkey JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey"

VIEWS = {"receipts": RECEIPTS, "expenditures": EXPENDITURES, "filings": FILINGS, "candidates": CANDIDATES, "links": LINKS, "committees": COMMITTEES} | {
    "lobby_clients": LOBBY_CLIENTS, "lobby_entities": LOBBY_ENTITIES, "payee_book": PAYEE_BOOK, "donor_book": DONOR_BOOK, "committee_book": COMMITTEE_BOOK, "orgs527": ORGS527,
    "directors527": DIRECTORS527, "spending527": SPENDING527, "candidate_book": CANDIDATE_BOOK, "federal_donors": FEDERAL_DONORS,
}
#: Views that most queries read: written once per session and state of their tables, as the refresh job does, and read from there.
STORED = {"receipts", "expenditures"}
_STORED: dict[tuple, tuple] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def civic(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A civic view over the tables in sf_dir."""
    text = VIEWS[view]
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def _state(spark: SparkSession, sf_dir: str, names: set[str]) -> tuple:
    """Files of the tables with size and time: a changed table gives another state."""
    out = []
    for n in sorted(names):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{n}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        out += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)]
    return tuple(out)


def stored(spark: SparkSession, sf_dir: str, view: str, name: str | None = None, build=None) -> DataFrame:
    """A view, or what `build` makes of it under a name, as a table in the shared folder; written again when the view's tables change."""
    names = set(re.findall(r"\{(\w+)\}", VIEWS[view]))
    state = _state(spark, sf_dir, names)
    key = (spark.sparkContext.applicationId, sf_dir, name or view)
    found = _STORED.get(key)
    if found is None or found[0] != state or not exists(found[1]):
        if found is not None:
            discard(found[1])
        found = _STORED[key] = (state, materialize(build() if build else civic(spark, sf_dir, view), name or view))
    return found[1]


def with_views(sql: str) -> str:
    """DuckDB SQL with the civic views it names as common table expressions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = [f"{v} AS ({VIEWS[v].format(**{t: t for t in re.findall(r'{(\w+)}', VIEWS[v])})})" for v in used]
    if not ctes:
        return sql
    sql = sql.strip()
    recursive = re.match(r"WITH RECURSIVE\b", sql, re.I)
    body = re.sub(r"^WITH(\s+RECURSIVE)?\b", "", sql, flags=re.I) if re.match(r"WITH\b", sql, re.I) else None
    head = f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(ctes)
    return f"{head}, {body}" if body is not None else f"{head} {sql}"
