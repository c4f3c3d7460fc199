"""Registered queries on the small tables, and the pipeline stage by stage against brute force."""

import os
import re
import sys
from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op2_lines", "op5_knn", "op6_mix", "op9_decontaminate"])
def test_oracle(spark, duck, name):
    from ledgerlens.llm.registry import ORACLES, QUERIES

    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    expect = duck.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert Counter(tuple(r) for r in got.select(*cols).collect()) == Counter(expect)


def test_every_query_keeps_every_row(spark, duck):
    from ledgerlens.llm.registry import QUERIES

    count = lambda t: duck.execute(f"SELECT count(*) FROM {t}").fetchone()[0]
    for name, table in (("op1_html", "pages"), ("op4_language", "documents"), ("op7_simhash", "documents"), ("op8_toxicity", "documents"), ("op9_decontaminate", "documents"), ("op10_shard", "documents")):
        assert QUERIES[name](spark, SF).count() == count(table), name
    chats = {r["conv_id"]: r["n_turns"] for r in QUERIES["op3_chat"](spark, SF).collect()}
    assert sum(chats.values()) == count("conversations") + 2 and chats[-1] == 2


CLASHES = "score string, predicted string, restored string, items string, spans string, n_words string, size string, target string, taken string, part string, epochs string, first_word string, fp string, component string, root string, key string, label string, source_size string"


def _messy(spark, docs):
    """documents with nulls, repeats, a null source and columns of every name that an operator adds."""
    from pyspark.sql import functions as F

    extra = [(None, None, None, None, None), (10**9, "", "en", None, 0), (10**9 + 1, " \t ", None, "zz", 3), (10**9 + 2, "one two", "en", "zz", 7), (10**9 + 2, "one two", "en", "zz", 7)]
    rows = docs.unionByName(spark.createDataFrame(extra, docs.schema)).unionByName(docs.limit(0))
    names = [c.split()[0] for c in CLASHES.split(", ")]
    return rows.select(*docs.columns, *[F.concat(F.lit(n + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(n) for n in names])


def _rows(df, names):
    return Counter(tuple(r) for r in df.select(*names).collect())


def test_pipeline_stages(spark):
    """Each stage against a plain version written apart, on rows with nulls, repeats and clashing names."""
    import corpus_pipeline as p

    from ledgerlens.llm import toxicity
    from ledgerlens.llm.common import id_crc, load
    from pyspark.sql import functions as F
    from test_operators import slow_components, slow_contamination, slow_fingerprint

    docs = _messy(spark, load(spark, SF, "documents")).cache()
    names, all_rows = docs.columns, docs.collect()
    every = Counter(tuple(r) for r in all_rows)

    one = p.drop_toxic(spark, docs, SF)
    model, lexicon = toxicity.train(docs, load(spark, SF, "labels").where(F.pmod(id_crc("doc_id"), F.lit(5)) != 0))
    restorer = toxicity.Restorer(model)

    def rejected(text):
        said = {}
        pairs = Counter()
        for token in set((text or "").lower().split()):
            best = max(((q, w, own) for w in restorer.token(token) for q, own in [lexicon.word(w)] if q or own), default=None)
            if best:
                said[best[1]] = best
        for run, found in restorer.spaced(text or "").items():
            best = max(((q, w, own) for w in found for q, own in [lexicon.word(w)] if q or own), default=None)
            if best:
                said[best[1]] = best
            inside = max((q for f, q in lexicon.inside if f in run), default=0.0)
            if inside > (best[0] if best else 0.0):
                said["in " + run] = (inside, run, ())
        clean = 1 - lexicon.base
        for q, _, own in said.values():
            clean *= 1 - q
            pairs.update(own)
        for f, n in pairs.items():
            clean *= 1 - lexicon.weights[f] if n > 1 else 1
        return 1 - clean >= 0.5

    assert one.columns == names and _rows(one, names) == Counter(tuple(r) for r in all_rows if not rejected(r["text"]))

    two = p.drop_near_copies(spark, docs, SF)
    group = slow_components([r["doc_id"] for r in all_rows], [slow_fingerprint(r["text"]) for r in all_rows])
    kept = _rows(two, names)
    assert two.columns == names and not kept - every
    assert Counter(r["doc_id"] for r in two.collect()) == Counter(set(group))

    three = p.drop_contaminated(spark, docs, SF)
    items = [(r["item_id"], r["text"]) for r in load(spark, SF, "benchmark").collect()]
    few = all_rows[:60] + all_rows[-5:]
    clean = Counter(tuple(r) for r in few if slow_contamination(r["text"], items)[1] == 0)
    found = _rows(three, names)
    assert three.columns == names and not found - every and all(found[r] == n if r in clean else not found[r] for r, n in Counter(map(tuple, few)).items())

    four = p.mix_sources(spark, docs, SF).collect()
    assert four[0].__fields__ == names
    cut = lambda t: [x for x in re.split("[\x20\x09-\x0D]+", t or "") if x]
    sizes, taken, copies = Counter(), Counter(), Counter()
    for r in all_rows:
        sizes[r["source"]] += len(cut(r["text"]))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, open_ = 1.5 * sum(sizes.values()), set(order)
    while True:
        level = (total - sum(2 * sizes[s] for s in order if s not in open_)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        open_ -= over
    by_id = {}
    for r in all_rows:
        by_id.setdefault((r["doc_id"], r["source"]), set()).add(r["text"])
    for r in four:
        taken[r["source"]] += len(cut(r["text"]))
        copies[r["doc_id"], r["source"]] += 1
        own = by_id[r["doc_id"], r["source"]]
        assert r["text"] in own or any(cut(t)[: len(cut(r["text"]))] == cut(r["text"]) and r["n_chars"] == len(r["text"]) for t in own)
        assert r["score"] == f"score:{'null' if r['doc_id'] is None else r['doc_id']}" and r["size"][:5] == "size:"
    for s in order:
        assert taken[s] == int((level * weight[s] if s in open_ else 2 * sizes[s]) + 1e-9), s
    present = Counter((r["doc_id"], r["source"]) for r in all_rows)
    assert all(n <= 2 * present[k] for k, n in copies.items())
    assert copies[None, None] == copies[10**9, None] == copies[10**9 + 1, "zz"] == 1

    five = p.shard_documents(spark, docs, SF)
    assert five.columns == names + ["shard", "slot"] and _rows(five, names) == every
    docs.unpersist()


def test_pipeline_stages_take_empty_tables(spark):
    import corpus_pipeline as p

    from ledgerlens.llm.common import load

    docs = load(spark, SF, "documents").where("false")
    for name, stage in p.STAGES:
        got = stage(spark, docs, SF)
        assert got.columns[: len(docs.columns)] == docs.columns and got.count() == 0, name


def test_pipeline_runs(spark):
    import corpus_pipeline as p

    got = p.run(spark, SF)
    assert got.columns[-2:] == ["shard", "slot"] and got.count() > 0
    assert [n for n, _ in p.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "sharding"]
