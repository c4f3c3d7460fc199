"""Matching jobs across registers, families of committees, text helpers and what is reported from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import text
from ledgerlens.operators import crossmatch, families, org527
from ledgerlens.plans.catalog import query

#: The same rules in DuckDB, written apart from the library: stop words, tokens, trigrams, Jaccard.
_STOP = "['the','of','for','and','in','inc','llc','ltd','co','corp','corporation','company','assoc','association','assn','group','committee','fund','pac','political','action','a','an']"
_TOK = "list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: NOT list_contains(" + _STOP + ", w)))"
_TRI = "list_distinct(flatten(list_transform(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: list_transform(generate_series(1, len(w) + 1), lambda i: substr('  ' || w || ' ', i::BIGINT, 3)))))"
_JAC = "len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"
_SAME = _JAC.format(a="x.w", b="y.w")


def names_sql(left: str, left_name: str, right: str, right_name: str, columns: str, best: str = "", threshold: float = 0.8) -> str:
    """Brute force over all pairs of distinct names."""
    pairs = f"""WITH l AS ({left}), r AS ({right}), ln AS (SELECT DISTINCT {left_name} AS n, {_TOK.format(c=left_name)} AS w FROM l WHERE {left_name} IS NOT NULL), rn AS (SELECT DISTINCT {right_name} AS n, {_TOK.format(c=right_name)} AS w FROM r WHERE {right_name} IS NOT NULL),
ix AS (SELECT n, w, unnest(w) AS t FROM ln), iy AS (SELECT n, w, unnest(w) AS t FROM rn), c AS (SELECT DISTINCT ix.n AS a, iy.n AS b, ix.w AS wa, iy.w AS wb FROM ix JOIN iy ON ix.t = iy.t),
m AS (SELECT a, b, round({_JAC.format(a='wa', b='wb')}, 4) AS score FROM c WHERE {_JAC.format(a='wa', b='wb')} >= {threshold}),
o AS (SELECT l.*, r.*, m.score FROM m JOIN l ON l.{left_name} = m.a JOIN r ON r.{right_name} = m.b)"""
    if not best:
        return f"{pairs} SELECT {columns}, score FROM o"
    return f"{pairs} SELECT {columns}, score FROM (SELECT *, row_number() OVER (PARTITION BY {best} ORDER BY score DESC, {left_name}, {right_name}) AS k FROM o) WHERE k = 1"


CLIENT_DONORS = names_sql("SELECT client_id, client_name FROM lobby_clients", "client_name", "SELECT donor_key, donor_name, total_amount FROM donor_book ORDER BY total_amount DESC, donor_key LIMIT 50000", "donor_name", "client_id, donor_key, client_name, donor_name")


def client_donors(t):
    donors = crossmatch.largest(t.donor_book).select("donor_key", "donor_name")
    return crossmatch.match_names(t.lobby_clients, donors, "client_name", "donor_name").select("client_id", "donor_key", "client_name", "donor_name", "score")


@query("match_client_donors", CLIENT_DONORS)
def _(t):
    return client_donors(t)


@query("match_client_payees", names_sql("SELECT 'client' AS source_type, client_id AS source_id, client_name AS source_name FROM lobby_clients UNION ALL SELECT 'entity', entity_id, entity_name FROM lobby_entities", "source_name", "SELECT DISTINCT payee_name, committee_id FROM payee_book WHERE trim(payee_name) <> ''", "payee_name", "source_type, source_id, source_name, payee_name, committee_id"))
def _(t):
    clients = t.lobby_clients.select(F.lit("client").alias("source_type"), F.col("client_id").alias("source_id"), F.col("client_name").alias("source_name"))
    entities = t.lobby_entities.select(F.lit("entity").alias("source_type"), F.col("entity_id").alias("source_id"), F.col("entity_name").alias("source_name"))
    return crossmatch.match_names(clients.unionByName(entities), t.payee_book.where("trim(payee_name) <> ''").distinct(), "source_name", "payee_name")


@query("match_orgs_committees", names_sql("SELECT DISTINCT ein, org_name FROM orgs527", "org_name", "SELECT committee_id, committee_name FROM committee_book", "committee_name", "ein, org_name, committee_id, committee_name", "ein, committee_id"))
def _(t):
    return crossmatch.match_names(t.orgs527.select("ein", "org_name").distinct(), t.committee_book.select("committee_id", "committee_name"), "org_name", "committee_name", best=["ein", "committee_id"])


@query("match_recipients", names_sql("SELECT DISTINCT ein, org_name, recipient_name FROM spending527 WHERE state = 'IL'", "recipient_name", "SELECT 'committee' AS matched_type, committee_id AS matched_id, committee_name AS matched_name FROM committee_book UNION ALL SELECT 'candidate', candidate_id, candidate_name FROM candidate_book WHERE register = 'state'", "matched_name", "ein, org_name, recipient_name, matched_type, matched_id, matched_name"))
def _(t):
    targets = t.committee_book.select(F.lit("committee").alias("matched_type"), F.col("committee_id").alias("matched_id"), F.col("committee_name").alias("matched_name")).unionByName(
        t.candidate_book.where("register = 'state'").select(F.lit("candidate").alias("matched_type"), F.col("candidate_id").alias("matched_id"), F.col("candidate_name").alias("matched_name"))
    )
    return crossmatch.match_names(t.spending527.where("state = 'IL'").select("ein", "org_name", "recipient_name").distinct(), targets, "recipient_name", "matched_name")


DIRECTOR_DONORS = names_sql("SELECT ein, org_name, person_name FROM directors527", "person_name", "SELECT donor_key, donor_name, total_amount FROM donor_book", "donor_name", "ein, org_name, person_name, donor_key, donor_name, total_amount")


def director_donors(t):
    return crossmatch.match_names(t.directors527.select("ein", "org_name", "person_name"), t.donor_book.select("donor_key", "donor_name", "total_amount"), "person_name", "donor_name")


@query("match_directors_donors", DIRECTOR_DONORS)
def _(t):
    return director_donors(t)


@query("match_directors_candidates", names_sql("SELECT ein, min(org_name) AS org_name, person_name FROM directors527 GROUP BY ein, person_name", "person_name", "SELECT register, candidate_id, candidate_name FROM candidate_book", "candidate_name", "ein, org_name, person_name, register, candidate_id, candidate_name", "ein, trim(person_name), register, candidate_id"))
def _(t):
    people = t.directors527.groupBy("ein", "person_name").agg(F.min("org_name").alias("org_name")).select("ein", "org_name", "person_name")
    return crossmatch.match_names(people, t.candidate_book, "person_name", "candidate_name", best=["ein", "person_name", "register", "candidate_id"])


def addresses_sql(left: str, left_name: str, lp: str, right: str, right_name: str, columns: str, keys: str, threshold: float) -> str:
    """Brute force over all pairs of one state and zip. lp: prefix of the left place columns; the right ones are c2, s2, z2."""
    sim = _JAC.format(a=_TRI.format(c=f"l.{left_name}"), b=_TRI.format(c=f"r.{right_name}"))
    return f"""WITH l AS ({left}), r AS ({right}), o AS (SELECT l.*, r.*, CASE WHEN lower(trim(l.{lp}city)) = lower(trim(r.c2)) THEN 1.0::DOUBLE ELSE 0.7 END AS address_score, round({sim}, 4) AS name_score
FROM l JOIN r ON upper(trim(l.{lp}state)) = upper(trim(r.s2)) AND substr(trim(l.{lp}zip), 1, 5) = substr(trim(r.z2), 1, 5) WHERE {sim} >= {threshold})
SELECT {columns}, address_score, name_score FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY name_score DESC, address_score DESC, {left_name}, {right_name}) AS k FROM o) WHERE k = 1"""


@query("match_directors_addresses", addresses_sql("SELECT * FROM directors527", "person_name", "", "SELECT donor_key, donor_name, city AS c2, state AS s2, zip AS z2 FROM donor_book", "donor_name", "ein, org_name, person_name, donor_key, donor_name", "ein, person_name, donor_key", 0.3))
def _(t):
    donors = t.donor_book.select("donor_key", "donor_name", F.col("city").alias("c2"), F.col("state").alias("s2"), F.col("zip").alias("z2"))
    found = crossmatch.match_addresses(t.directors527, donors, "person_name", "donor_name", (("city", "state", "zip"), ("c2", "s2", "z2")), 0.3, ["ein", "person_name", "donor_key"])
    return found.select("ein", "org_name", "person_name", "donor_key", "donor_name", "address_score", "name_score")


_STACK = " UNION ".join(f"SELECT ein, org_name, '{k.rstrip('_') or 'org'}' AS address_type, {k}city AS org_city, {k}state AS org_state, {k}zip AS org_zip FROM orgs527 WHERE {k}state IS NOT NULL AND {k}zip IS NOT NULL" for k in ("", "custodian_", "contact_", "business_"))


@query("match_org_addresses", f"""SELECT 'committee' AS matched_type, ein, address_type, committee_id::VARCHAR AS matched_id, address_score, name_score FROM ({addresses_sql(_STACK, 'org_name', 'org_', 'SELECT committee_id, committee_name, city AS c2, state AS s2, zip AS z2 FROM committee_book', 'committee_name', 'ein, address_type, committee_id', 'ein, address_type, committee_id', 0.3)})
UNION ALL SELECT 'donor', ein, address_type, donor_key, address_score, name_score FROM ({addresses_sql(_STACK, 'org_name', 'org_', 'SELECT donor_key, donor_name, city AS c2, state AS s2, zip AS z2 FROM donor_book', 'donor_name', 'ein, address_type, donor_key', 'ein, address_type, donor_key', 0.2)})""")
def _(t):
    stacked = crossmatch.stack_addresses(t.orgs527)
    out = None
    for kind, book, key, name, threshold in (("committee", t.committee_book, "committee_id", "committee_name", 0.3), ("donor", t.donor_book, "donor_key", "donor_name", 0.2)):
        right = book.select(key, name, F.col("city").alias("c2"), F.col("state").alias("s2"), F.col("zip").alias("z2"))
        found = crossmatch.match_addresses(stacked, right, "org_name", name, (("org_city", "org_state", "org_zip"), ("c2", "s2", "z2")), threshold, ["ein", "address_type", key], keep=["ein", "address_type", key])
        found = found.select(F.lit(kind).alias("matched_type"), "ein", "address_type", F.col(key).cast("string").alias("matched_id"), "address_score", "name_score")
        out = found if out is None else out.unionByName(found)
    return out


CLIENT_ORGS = names_sql("SELECT client_id, client_name FROM lobby_clients", "client_name", "SELECT DISTINCT ein, org_name FROM orgs527", "org_name", "client_id, client_name, ein, org_name", "client_id, ein")


def client_orgs(t):
    return crossmatch.match_names(t.lobby_clients, t.orgs527.select("ein", "org_name").distinct(), "client_name", "org_name", best=["client_id", "ein"])


@query("match_client_orgs", CLIENT_ORGS)
def _(t):
    return client_orgs(t)


# Reports over matches


@query("lobbying_donor_overlap", f"SELECT client_name, donor_name, score, d.total_amount AS donor_total FROM ({CLIENT_DONORS}) m JOIN (SELECT donor_key AS dk, total_amount FROM donor_book) d ON m.donor_key = d.dk WHERE d.total_amount > 100000 ORDER BY d.total_amount DESC, client_id, donor_key LIMIT 20")
def _(t):
    donors = t.donor_book.select(F.col("donor_key").alias("dk"), F.col("total_amount").alias("donor_total"))
    found = client_donors(t).join(donors, F.col("donor_key") == F.col("dk"), "left").where("donor_total > 100000")
    return found.orderBy(F.desc("donor_total"), "client_id", "donor_key").limit(20).select("client_name", "donor_name", "score", "donor_total")


@query("director_donor_overlap", f"SELECT org_name, person_name, donor_name, score, total_amount AS donor_total FROM ({DIRECTOR_DONORS}) m WHERE total_amount > 100000 ORDER BY total_amount DESC, ein, donor_key LIMIT 15")
def _(t):
    found = director_donors(t).where("total_amount > 100000").orderBy(F.desc("total_amount"), "ein", "donor_key").limit(15)
    return found.select("org_name", "person_name", "donor_name", "score", F.col("total_amount").alias("donor_total"))


@query("org_triple", f"SELECT client_name, org_name, ein, score FROM ({CLIENT_ORGS}) m ORDER BY score DESC, client_id, ein LIMIT 200")
def _(t):
    return client_orgs(t).orderBy(F.desc("score"), "client_id", "ein").limit(200).select("client_name", "org_name", "ein", "score")


# Families of committees

_NORM = "trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"
PAIRS_SQL = f"""cm AS (SELECT committee_id AS id, {_NORM.format(c='committee_name')} AS nm, {_NORM.format(c='street')} AS st, {_NORM.format(c='zip')} AS zp, lower(trim(officer)) AS of, zip, {_TRI.format(c=_NORM.format(c='committee_name'))} AS w FROM committee_book),
cp AS (SELECT DISTINCT a.committee_id AS c1, b.committee_id AS c2 FROM links a JOIN links b ON a.candidate_id = b.candidate_id AND a.committee_id < b.committee_id),
sp AS (SELECT c1, c2, x.nm <> '' AND x.nm = y.nm AS same_name, {_JAC.format(a='x.w', b='y.w')} >= 0.8 AS similar_name, x.st <> '' AND x.st = y.st AND x.zp = y.zp AS same_address, coalesce(x.of <> '' AND x.of = y.of, FALSE) AS shared_officer FROM cp JOIN cm x ON x.id = c1 JOIN cm y ON y.id = c2),
st AS (SELECT * FROM sp WHERE same_name OR similar_name OR same_address OR shared_officer)"""


@query("committee_family_pairs", f"WITH {PAIRS_SQL} SELECT * FROM st")
def _(t):
    return families.strong_pairs(t.committee_book, t.links, families.officers(t.committee_book))


@query("committee_family_weak_pairs", f"WITH {PAIRS_SQL} SELECT x.id AS c1, y.id AS c2, round({_SAME}, 3) AS sim FROM cm x JOIN cm y ON x.zip = y.zip AND x.id < y.id WHERE {_SAME} >= 0.8 AND (x.id, y.id) NOT IN (SELECT c1, c2 FROM cp)")
def _(t):
    return families.weak_pairs(t.committee_book, t.links)


@query("committee_families", f"WITH RECURSIVE {PAIRS_SQL}, q AS (SELECT c1 AS node, c2 AS other FROM st UNION SELECT c2, c1 FROM st), h(node, root) AS (SELECT node, node FROM q UNION SELECT q.other, h.root FROM h JOIN q ON h.node = q.node), f AS (SELECT node AS committee_id, min(root) AS family_id FROM h GROUP BY 1) SELECT committee_id, family_id, sha1(string_agg(committee_id::VARCHAR, ',' ORDER BY committee_id) OVER (PARTITION BY family_id ORDER BY committee_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS member_hash FROM f")
def _(t):
    return families.families(families.strong_pairs(t.committee_book, t.links, families.officers(t.committee_book)))


# Registered organizations: latest registration, ledger, rollups, graph


@query("org527_latest", "SELECT ein, org_name, city, state FROM (SELECT *, row_number() OVER (PARTITION BY ein ORDER BY org_name DESC, zip DESC NULLS LAST) AS k FROM orgs527) WHERE k = 1")
def _(t):
    return org527.latest(t.orgs527, [F.desc("org_name"), F.col("zip").desc_nulls_last()]).select("ein", "org_name", "city", "state")


@query("org527_ledger", "SELECT ein, recipient_name, count(*) AS n, round(sum(amount), 2) AS total_amount, min(paid_on) AS first_day, max(paid_on) AS last_day FROM spending527 GROUP BY ein, recipient_name")
def _(t):
    return org527.ledger(t.spending527, "recipient_name")


@query("org527_rollup", "SELECT ein, year(paid_on)::INT AS year, count(*) AS n, count(DISTINCT recipient_name) AS recipients, round(sum(amount), 2) AS total_amount, round(coalesce(sum(amount) FILTER (WHERE state = 'IL'), 0), 2) AS home_amount FROM spending527 GROUP BY ALL")
def _(t):
    return org527.rollup(t.spending527)


@query("org527_dark_money", "WITH s AS (SELECT ein, round(sum(amount), 2) AS total_amount, count(*) AS n FROM spending527 WHERE state = 'IL' GROUP BY 1) SELECT count(*) AS organizations, sum(n)::BIGINT AS payments, round(sum(total_amount), 2) AS total_amount, max(total_amount) AS largest, round(max(total_amount) / sum(total_amount), 6) AS largest_share FROM s")
def _(t):
    return org527.dark_money(t.spending527)


@query("org527_graph", f"""WITH m AS ({names_sql("SELECT DISTINCT ein, org_name FROM orgs527", "org_name", "SELECT committee_id, committee_name FROM committee_book", "committee_name", "ein, org_name, committee_id, committee_name", "ein, committee_id")}), d AS ({DIRECTOR_DONORS}),
e AS (SELECT 'org:' || ein AS src, 'payee:' || recipient_name AS dst, 'payment' AS edge_type, round(sum(amount), 2) AS weight FROM spending527 GROUP BY ALL UNION ALL SELECT 'org:' || ein, 'committee:' || committee_id, 'name_match', max(score) FROM m GROUP BY ALL UNION ALL SELECT 'donor:' || donor_key, 'org:' || ein, 'director', max(score) FROM d GROUP BY ALL)
SELECT edge_type, src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY edge_type ORDER BY weight DESC, src, dst) AS k FROM e) WHERE k <= 150""")
def _(t):
    committees = crossmatch.match_names(t.orgs527.select("ein", "org_name").distinct(), t.committee_book.select("committee_id", "committee_name"), "org_name", "committee_name", best=["ein", "committee_id"])
    return org527.graph(t.spending527, committees, director_donors(t), 150)


# Text helpers


@query("name_key_aliases", "WITH n AS (SELECT c_custkey, ['Mike','Michael','Bob','Robert','Kate','Kathleen','Ana'][c_custkey % 7 + 1] AS f, 'Lee' || (c_custkey % 5)::VARCHAR AS l FROM customer), al(a, b) AS (VALUES ('mike', 'michael'), ('michael', 'mike'), ('bob', 'robert'), ('robert', 'bob'), ('kate', 'katherine'), ('kate', 'kathleen'), ('kathleen', 'kate'), ('kathleen', 'katie'), ('robert', 'rob')) SELECT x.c_custkey AS left_id, y.c_custkey AS right_id FROM n x JOIN n y ON x.l = y.l AND x.c_custkey < y.c_custkey AND x.c_custkey < 100 AND y.c_custkey < 100 WHERE x.f = y.f OR EXISTS (SELECT 1 FROM al WHERE a = lower(x.f) AND b = lower(y.f))")
def _(t):
    first = F.element_at(F.array(*[F.lit(x) for x in ("Mike", "Michael", "Bob", "Robert", "Kate", "Kathleen", "Ana")]), (F.col("c_custkey") % 7 + 1).cast("int"))
    name = F.concat(first, F.lit(" Q. Lee"), (F.col("c_custkey") % 5).cast("string"), F.lit(", Jr."))
    rows = t.customer.where("c_custkey < 100").select("c_custkey", text.name_key(name).alias("key"), text.name_keys(name).alias("keys"))
    a = rows.select(F.col("c_custkey").alias("left_id"), F.explode("keys").alias("key"))
    return a.join(rows.select(F.col("c_custkey").alias("right_id"), "key"), "key").where("left_id < right_id").select("left_id", "right_id").distinct()


@query("name_search", """SELECT client_id, client_name FROM lobby_clients WHERE (regexp_matches(lower(client_name), '(^|[^a-z0-9])sm') AND regexp_matches(lower(client_name), '(^|[^a-z0-9])gi'))""")
def _(t):
    return t.lobby_clients.where(text.name_matches(F.col("client_name"), "Sm gi")).select("client_id", "client_name")


@query("metadata_split", "SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS occupation, CASE WHEN c_custkey % 2 = 0 THEN 'Nation ' || c_nationkey END AS employer FROM customer")
def _(t):
    occupation = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("  Occupation:  "), "c_mktsegment")).otherwise("")
    employer = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" - EMPLOYER: Nation "), F.col("c_nationkey").cast("string"), F.lit(" ;"))).otherwise("")
    cell = F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", employer, occupation)).otherwise(F.concat("c_name", occupation, employer))
    return t.customer.select("c_custkey", text.split_metadata(cell).alias("m")).select("c_custkey", "m.name", "m.occupation", "m.employer")


@query("noise_names", "SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 1) THEN TRUE ELSE FALSE END AS noise FROM part")
def _(t):
    kind = F.col("p_partkey") % 4
    name = F.when(kind == 0, F.concat(F.lit(" 12 . "), F.col("p_partkey").cast("string"), F.lit("\u2026"))).when(kind == 1, F.lit(None)).when(kind == 2, F.col("p_name")).otherwise(F.concat(F.lit("4 "), F.col("p_name")))
    return t.part.select("p_partkey", text.is_noise_name(name).alias("noise"))


@query("federal_codes", "SELECT p_partkey, ['H','S','P',NULL][p_partkey % 4 + 1] AS office, CASE WHEN p_partkey % 4 = 0 THEN lpad((p_size)::VARCHAR, 2, '0') END AS district, ['DEM','REP',NULL,'LIB','XYZ'][p_partkey % 5 + 1] AS party, (60000 + p_partkey % 99)::VARCHAR AS zip5 FROM part")
def _(t):
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("p_partkey") % n + 1).cast("int"))
    office = text.office_code(pick(4, "US House of Reps", " SENATE", "President", "Mayor"))
    party = text.party_code(pick(5, " Democratic", "republican", "Whig party", "Libertarian", "xyz"))
    return t.part.select("p_partkey", office.alias("office"), text.district_code(F.concat(F.lit("IL-"), F.col("p_size").cast("string")), office).alias("district"), party.alias("party"), text.zip5(F.concat(F.lit("IL "), (60000 + F.col("p_partkey") % 99).cast("string"), F.lit("-1234"))).alias("zip5"))


@query("race_keys", "SELECT p_partkey, lower(p_type) || '-' || lower(replace(p_brand, '#', '-')) || '-' || p_size AS race, lower(p_type) AS bare FROM part")
def _(t):
    key = text.race_key(F.col("p_type"), F.lit(None), F.concat(F.lit("  "), "p_brand", F.lit("!!")), F.col("p_size"))
    return t.part.select("p_partkey", key.alias("race"), text.canonical_race_key(F.concat(F.lower("p_type"), F.lit("-0123abcdef"))).alias("bare"))
