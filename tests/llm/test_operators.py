"""Each operator against a brute-force version and on the defined edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from ledgerlens.llm import chat, common, components, decontamination, html_text, knn, language, line_dedup, mixing, sharding, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


EDGE = [(1, None, "a"), (2, "", "b"), (None, "one two", None), (3, "one two", "a"), (3, "one two", "a"), (4, "x" * 50_000, None), (5, words(20_000, 5), "b"), (6, " \n\t ", "a")]


# op1


def test_html_template_and_edges(spark):
    page = (
        "<html><head><title>t</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body><div id='cookie-banner'>We use cookies</div>"
        "<nav><ul><li><a href='/x'>Home</a></li></ul></nav><article><h1>The  title</h1><p>First &amp; best <a href='/y'>link</a>\n words.</p>"
        "<aside>Related story</aside><form><label>Mail</label></form><p>Second<br>part.</p></article><section class='comments'><p>Nice post I liked it a lot.</p></section>"
        "<footer>&copy; 2020</footer></body></html>"
    )
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "plain text"), (1, "u", page)], "page_id long, text string, html string")
    got = [(r["page_id"], r["text"]) for r in html_text.extract_pages(df).collect()]
    text = "The title\n\nFirst & best link words.\n\nSecond part."
    assert sorted(got) == sorted([(1, text), (2, ""), (3, ""), (4, "plain text"), (1, text)])


def test_html_without_article_mark():
    body = "".join(f"<p>{words(30, i)}</p>" for i in range(5))
    page = f"<body><div class='menu'><a href=1>one</a> <a href=2>two</a></div><div><h1>Head line</h1>{body}</div><div class='related'><a href=3>more</a></div></body>"
    assert html_text.extract(page) == ["Head line", *[words(30, i) for i in range(5)]]


def test_best_run_is_the_maximum():
    rng = random.Random(3)
    for _ in range(200):
        s = [rng.uniform(-2, 2) for _ in range(rng.randint(0, 12))]
        a, b = html_text.best_run(s)
        best = max((sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0.0)
        assert sum(s[a:b]) == pytest.approx(max(best, 0.0))


@pytest.mark.parametrize("attrs", ["class='post-123 post hentry category-news tag-politics'", "class='post tag-side category-search'", "class='story aside' id='discussion'", "class='post-7 post format-aside'"])
def test_html_names_of_the_article(attrs):
    body = f"<h1 id='comments'>Head</h1><p>{words(30, 1)}</p>"
    menu = "<div class='site-menu'><a href='/'>Home</a></div>"
    for element in ("article", "main"):
        assert html_text.extract(f"<body>{menu}<{element} {attrs}>{body}</{element}><div id='comments'><p>{words(9, 2)}</p></div></body>") == ["Head", words(30, 1)]
    if "post-" in attrs:
        assert html_text.extract(f"<body>{menu}<div {attrs}>{body}</div><div id='comments'><p>{words(9, 2)}</p></div></body>") == ["Head", words(30, 1)]


def test_html_names_inside_the_article():
    keep = ["<h2 id='related-work'>%s</h2>", "<section id='discussion'><p>%s</p></section>", "<div class='section' id='search-results'><p>%s</p></div>", "<div class='content side-by-side'><p>%s</p></div>", "<p class='legal-history'>%s</p>", "<h3 class='social-policy'>%s</h3>"]
    drop = ["<div class='share-buttons'>%s</div>", "<section id='comments'><p>%s</p></section>", "<div id='related-posts'>%s</div>", "<p class='tags'>%s</p>", "<article class='comment'><p>%s</p></article>", "<h2 hidden>%s</h2>", "<div class='tag-cloud'>%s</div>"]
    for wrap in ("<article>%s</article>", "<div class='entry-content'>%s</div>", "<main><article class='tag-x'>%s</article></main>"):
        inner = "".join(k % words(9, i) + d % words(8, 50 + i) for i, (k, d) in enumerate(zip(keep + ["<p>%s</p>"], drop)))
        page = f"<body><nav><a href='/'>Home</a></nav>{wrap % (inner + '<p>End of the text.</p>')}<footer>Foot</footer></body>"
        assert html_text.extract(page) == [words(9, i) for i in range(7)] + ["End of the text."]
    plain = "".join(k % words(20, i) for i, k in enumerate(keep[:4]))
    assert html_text.extract(f"<body>{plain}</body>") == [words(20, i) for i in range(4)]


def test_html_marks_are_balanced():
    a, b, c = (words(20, i) for i in range(3))
    say = html_text.extract
    assert say(f"<main><p>{a}</p><article class='related'><p>teaser</p></article><p>{b}</p><p>{c}</p></main>") == [a, b, c]
    assert say(f"<article><p>{a}</p><article class='promo'><p>teaser</p></article><p>{b}</p></article><p>after</p>") == [a, b]
    assert say(f"<main><div class='entry-content'><p>{a}</p></div></main><div>box</div>") == [a]
    assert say(f"<div class='post-content'><p>{a}</p></div><div>box</div>") == [a]
    assert say(f"<article class='story ad-free'><p>{a}</p></article>") == [a]
    assert say(f"<div class='discussion-paper'><p>{a}</p></div>") == [a]
    assert say(f"<article><p>one <label>two</label> three {a}</p></article>") == [f"one two three {a}"]


def test_html_run_over_whole_pages():
    weights = html_text.fit_weights()
    for k, (found, _) in enumerate(html_text.labelled_pages(40, seed=23)):
        scores = html_text.token_scores(found, weights)
        a, b = html_text.best_run(scores)
        sums = np.concatenate(([0.0], np.cumsum(scores)))
        best = max(float(sums[j + 1 :].max() - sums[j]) for j in range(len(scores)))
        assert sums[b] - sums[a] == pytest.approx(max(best, 0.0)), k


def test_html_weights_are_learned(spark):
    pages = [(f"<body><nav><a href=1>{words(9, i)}</a></nav><article><p>{words(40, i)}</p></article><div>{words(9, -i)}</div></body>",) for i in range(30)] + [(None,), ("",), ("no mark",)]
    learned = html_text.fit_weights(spark.createDataFrame(pages, "html string"))
    counts = html_text.composed_counts()
    for (page,) in pages[:30]:
        found = html_text.tokens(page)
        counts.update(html_text.count_features(found, [w == "in" for w in html_text.places(found)]))
    assert learned == html_text.weights_of(counts) != html_text.fit_weights()
    assert learned["word", "in"] > 0 > learned["word", "out"] and learned["tag", "blind"] < 0 < learned["word", "blind"]


@pytest.mark.parametrize("unit", ["<b>{}</b>", "<i>{}<p>", "<b>{}<div class='x'>{}</b>", "<a <", "<div class=class=>", "<article>{}", "<p class='main"])
def test_html_time_is_linear(unit):
    import time

    def seconds(n):
        start = time.perf_counter()
        html_text.extract("".join(part * n for part in unit.split("{}")))
        return time.perf_counter() - start

    seconds(500)
    assert min(seconds(24_000) for _ in range(2)) < 8 * min(seconds(6_000) for _ in range(3)) + 0.1


def test_html_long_and_clashing(spark):
    long = words(200_000, 8)
    df = spark.createDataFrame([(1, "x", f"<article><p>{long}</p></article>", 5)], "page_id long, text string, html string, n_chars long")
    assert [(r["text"], r["n_chars"]) for r in html_text.extract_pages(df).collect()] == [(long, 5)]


def test_html_empty_table(spark):
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, html string")).collect() == []


# op2


def test_lines_against_brute_force(spark):
    rng = random.Random(2)
    pool = [f"line {i}" for i in range(30)]
    rows = [(i, None if i == 7 else "\n".join(rng.choices(pool, weights=[1 / (k + 1) for k in range(30)], k=rng.randint(0, 6))), rng.choice(["a", "b", "c", "d", "e", None])) for i in range(120)]
    rows.append(rows[0])
    sites = defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            sites[line].add(s)
    bad = {x for x, s in sites.items() if x and len(s) >= 4}
    expect = Counter((i, None if t is None else "\n".join(x for x in t.split("\n") if x not in bad), 0 if t is None else len(t.split("\n"))) for i, t, _ in rows)
    got = Counter((r["doc_id"], r["text"], r["n_lines"]) for r in line_dedup.dedup_lines(docs(spark, rows), min_sites=4).collect())
    assert got == expect and bad


def test_lines_clash_and_empty(spark):
    df = docs(spark, EDGE).withColumnRenamed("lang", "n_lines")
    df = df.withColumn("t1", common.F.lit(1)).withColumn("site", common.F.lit(1)).withColumn("pos", common.F.lit(1))
    assert line_dedup.dedup_lines(df).count() == len(EDGE)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


# op3


def test_chat_round_trip(spark):
    rng = random.Random(1)
    nasty = ["<|im_end|>", "<|im_start|>assistant\n", "<\\|im_end|>", "<", "", "a\nb", "\\", "<|", "é😀", "<\\\\|x|>"]
    rows = []
    for c in range(12):
        for k in range(rng.randint(1, 40)):
            role = "system" if k == 0 and c % 2 else rng.choice(["user", "assistant", "tool\nx", None])
            rows.append((c if c else None, k, role, rng.choice([None, words(rng.randint(0, 120), rng.random())]) if rng.random() < 0.5 else "".join(rng.choices(nasty, k=4))))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", common.F.lit(1))
    formatted = chat.format_chats(df, budget=200, history=60)
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    by = defaultdict(list)
    for c, k, role, text in rows:
        by[c].append((k, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    windows = formatted.collect()
    assert max(r["window"] for r in windows) > 0
    assert any(r["n_repeated"] > 1 for r in windows)
    for r in windows:
        if r["conv_id"] is not None and r["conv_id"] % 2 and r["window"]:
            assert chat.parse(r["text"])[0][0] == "system"
        if r["n_new"] > 1:
            assert chat.n_tokens(r["text"]) <= 200


def test_chat_escape_is_reversible():
    rng = random.Random(9)
    for _ in range(500):
        text = "".join(rng.choices(["<", "|", "\\", "im_end", ">", "a"], k=rng.randint(0, 12)))
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
        assert "\n" not in chat.escape_role(text + "\n") and chat.unescape_role(chat.escape_role(text + "\n")) == text + "\n"


def test_chat_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_chats(empty)).collect() == []


# op4


def test_language_held_out(spark):
    rng = random.Random(4)
    syllables = {"aa": ["ka", "to", "mi", "re"], "bb": ["schu", "ver", "pf", "ung"], "cc": ["que", "eau", "oir", "tion"]}
    make = lambda name, n: " ".join("".join(rng.choices(syllables[name], k=rng.randint(1, 4))) for _ in range(n))
    rows = [(i, make(n, rng.randint(5, 200)), n) for i, n in enumerate(rng.choices([*syllables], k=150))]
    train = spark.createDataFrame([*rows[:100], (None, None, "aa"), (999, "x", None)], "doc_id long, text string, lang string")
    model = language.train(train)
    assert model.langs == ["aa", "bb", "cc"]
    test = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows[100:]] + [(-1, None, 0.0), (-2, " 12 !", 0.0), (-3, "", 0.0), (-4, make("aa", 100) + " " + make("bb", 60), 0.0)], "doc_id long, text string, score double")
    got = {r["doc_id"]: r for r in language.identify(test, model).collect()}
    assert len(got) == 54
    assert sum(got[i]["lang_pred"] == n for i, _, n in rows[100:]) >= 49
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (-1, -2, -3))
    mixed = got[-4]["languages"]
    assert set(mixed) == {"aa", "bb"} and got[-4]["lang_pred"] == max(mixed, key=mixed.get) and all(0 <= r["score"] <= 1 for r in got.values())


def test_language_beyond_the_bmp():
    model = language.Model(["aa"], (np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1)))
    emoji = "\U0001f600\U0001f680 \U0001f44d\U0001f3fd \U0001f1e9\U0001f1ea"
    assert language.mixtures(model, [emoji, " 12 3", "x"]) == [("und", 0.0, {})] * 2 + language.mixtures(model, ["x"])
    assert not common.classes(emoji).any() and common.classes("\U0010ffff").tolist() == [0]
    letters = common.letter_codes("\U00010330\u0416\U00020000Z\u00c9 1")  # scripts keep their letters, lower-cased
    assert letters.tolist() == [0x10330, 0x436, 0x20000, ord("z"), 0xE9, 0, 0]
    assert common.classes("\U00010400").tolist() == common.classes("\U00010428").tolist()
    assert language.mixtures(model, ["\U00010330\U00010331"])[0][0] == "aa"


def slow_mixture(model_counts, text, segment=80, penalty=6.0, rounds=12, smooth=0.5):
    """One text, plain Python floats: segments, EM, backward elimination."""
    import math

    codes = [0, 0] + [ord(ch.lower()[0]) if ch.isalpha() else 0 for ch in text]
    if not any(codes):
        return "und", 0.0, set()
    g = language.grams(np.array(codes, np.uint32)).tolist()
    names = sorted(model_counts)
    seen = len({x for c in model_counts.values() for x in c})
    logp = {n: lambda x, c=model_counts[n], t=sum(model_counts[n].values()): math.log((c.get(x, 0) + smooth) / (t + smooth * seen)) for n in names}
    many = max(1, (len(text) + 2) // segment)
    cuts = [k * segment for k in range(many)] + [len(text)]
    ll = [[sum(logp[n](g[i]) for i in range(a, b) if codes[i + 2]) for n in names] for a, b in zip(cuts, cuts[1:])]

    def em(on):
        share = {k: 1 / len(on) for k in on}
        rel = [{k: math.exp(row[k] - max(row[j] for j in on)) for k in on} for row in ll]
        for _ in range(rounds):
            new = dict.fromkeys(on, 0.0)
            for r in rel:
                z = sum(r[k] * share[k] for k in on)
                for k in on:
                    new[k] += r[k] * share[k] / z / many
            share = new
        return share, sum(math.log(max(sum(r[k] * share[k] for k in on), 1e-300)) + max(row[j] for j in on) for r, row in zip(rel, ll))

    on = list(range(len(names)))
    share, total = em(on)
    while len(on) > 1:
        fewer = [k for k in on if k != min(on, key=lambda k: (share[k], k))]
        s, t = em(fewer)
        if t + penalty < total:
            break
        on, share, total = fewer, s, t
    k = max(on, key=lambda k: (share[k], -k))
    return names[k], share[k], {names[j] for j in on}


def test_language_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    syllables = {"aa": ["ka", "to", "mi", "re"], "bb": ["schu", "ver", "pf", "\u00fcng"], "cc": ["\u0436\u0430", "\u0442\u043e", "\U00010330", "re"]}
    make = lambda name, n: " ".join("".join(rng.choices(syllables[name], k=rng.randint(1, 4))) for _ in range(n))
    train = [(make(n, rng.randint(1, 60)), n) for n in rng.choices([*syllables], k=40)]
    counts = {n: Counter() for n in syllables}
    for text, name in train:
        codes = common.letter_codes(text)
        both = np.concatenate((np.zeros(2, np.uint32), codes))
        counts[name].update(language.grams(both)[codes > 0].tolist())
    texts = [None, "", "1 2", *[" ".join(make(n, rng.randint(1, 80)) for n in rng.choices([*syllables], k=rng.randint(1, 3))) for _ in range(40)], make("aa", 900) + make("cc", 700)]
    expect = [slow_mixture(counts, t or "") for t in texts]
    # Blocks far smaller than the texts: short and long texts, and the counting, must not depend on them.
    for block, rows in ((1 << 20, 1 << 16), (97, 3)):
        monkeypatch.setattr(language, "ROWS", rows)
        monkeypatch.setattr(language, "BLOCK", block)
        monkeypatch.setattr(language.decoded, "__defaults__", (block,))
        monkeypatch.setattr(common.text_blocks, "__defaults__", (block,))
        model = language.train(spark.createDataFrame(train, "text string, lang string"))
        for dense in (64, 0):
            triples = [(k, g, n) for k, name in enumerate(sorted(counts)) for g, n in counts[name].items()]
            own = language.Model(sorted(counts), tuple(np.array(x) for x in zip(*triples)), dense=dense)
            if dense:
                assert np.allclose(own.logp, model.logp)
            got = language.mixtures(own, texts)
            for (name, score, found), (a, b, c) in zip(got, expect):
                assert (name, set(found)) == (a, c) and score == pytest.approx(b, abs=1e-3)


def test_language_counts_long_texts(spark, monkeypatch):
    long = words(3_000, 3)
    df = spark.createDataFrame([(long, "aa"), ("x", "aa")], "text string, lang string")
    codes = [common.letter_codes(t) for t in (long, "x")]
    expect = sum((Counter(language.grams(np.concatenate((np.zeros(2, np.uint32), c)))[c > 0].tolist()) for c in codes), Counter())
    assert Counter({r["gram"]: r["n"] for r in language.count_trigrams(df).collect()}) == expect
    parts = [*language.decoded(long.encode(), 101)]
    assert len(parts) > 100 and np.array_equal(np.concatenate(parts), codes[0])


def test_language_many_languages():
    rng = np.random.default_rng(1)
    names = [f"l{i:03}" for i in range(150)]
    texts = ["".join(chr(0x4E00 + 40 * i + int(x)) if x < 30 else " " for x in rng.integers(0, 40, 300)) for i in range(150)]
    triples = []
    for k, t in enumerate(texts):
        codes = common.letter_codes(t)
        triples += [(k, g, n) for g, n in Counter(language.grams(np.concatenate((np.zeros(2, np.uint32), codes)))[codes > 0].tolist()).items()]
    model = language.Model(names, tuple(np.array(x) for x in zip(*triples)))
    assert model.logp is None and [x[0] for x in language.mixtures(model, texts)] == names


def test_language_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.train(empty)
    assert model.langs == [] and language.identify(empty, model).collect() == []
    assert language.mixtures(model, ["abc"])[0][0] == "und"


# op5


def slow_knn(ids, whole, queries, k):
    out, ints = [], [[int(x) for x in row] for row in whole]
    for q in queries:
        s = [sum(a * b for a, b in zip(ints[q], row)) for row in ints]
        order = sorted((i for i in range(len(ids)) if ids[i] != ids[q]), key=lambda i: (-s[i], ids[i]))[:k]
        out += [(ids[q], r + 1, ids[i], s[i]) for r, i in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("block, part", [(16, 64), (3, 7), (8_192, 524_288)])
def test_knn_against_brute_force(spark, monkeypatch, block, part):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(150, 8)), np.repeat(rng.normal(size=(1, 8)), 80, axis=0), rng.normal(size=(40, 8)) * 5])
    ids = [*range(len(v) - 20), *[7] * 20]  # an id repeated
    rows = [(i, [float(x) for x in r], "x") for i, r in zip(ids, v)] + [(1000, None, "x"), (1001, [None] + [0.0] * 7, "x"), (1002, [float("nan")] * 8, "x"), (1003, [float("inf")] * 8, "x"), (None, [1.0] * 8, "x"), (1004, [1.0], "x")]
    data = knn.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string"))
    monkeypatch.setattr(knn, "QUERY_BLOCK", block)
    monkeypatch.setattr(knn, "DATA_SLICE", part)
    got = sorted(tuple(r) for r in knn.top_k(data.where("id % 3 = 0"), data, k=7).collect())
    whole = np.floor(64 * v.astype(np.float32).astype(np.float64))
    assert got == slow_knn(ids, whole, [i for i in range(len(v)) if ids[i] % 3 == 0], 7)


def test_knn_large_numbers(spark):
    rng = np.random.default_rng(6)
    v = np.concatenate([np.floor(rng.normal(size=(40, 4)) * 3e8), np.floor(rng.normal(size=(10, 4)) * 100)])
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    assert sorted(tuple(r) for r in knn.top_k(rows.where("id % 2 = 0"), rows, k=5).collect()) == slow_knn(list(range(50)), v, range(0, 50, 2), 5)
    whole = knn.integer_vectors(spark.createDataFrame([(1, [1e30, -0.01, -1.5])], "vec_id long, embedding array<double>")).first()["v"]
    assert whole == [64e30, -1.0, -96.0]


def test_knn_clusters_prune(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16)) * 400
    v = np.floor(np.repeat(centres, 250, axis=0) + rng.normal(size=(3000, 16)))
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    old, report = knn.QUERY_BLOCK, {}
    knn.QUERY_BLOCK = 13
    try:
        got = sorted(tuple(r) for r in knn.top_k(rows.where("id % 20 = 0"), rows, k=5, report=report).collect())
    finally:
        knn.QUERY_BLOCK = old
    assert got == slow_knn(list(range(3000)), v.astype(int), range(0, 3000, 20), 5)
    assert report["groups"] >= 12 and report["replication"] < report["groups"] / 3


def test_knn_few_and_none(spark):
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0])], "id long, v array<double>")
    assert [tuple(r) for r in knn.top_k(two.where("id = 0"), two).collect()] == [(0, 1, 1, 1)]
    none = two.where("id < 0")
    assert knn.top_k(none, two).collect() == [] and knn.top_k(two, none).collect() == []


# op6


def test_mix_budgets(spark):
    rows = [(i, None if i == 3 else words(i % 50, i), ["a", "b", "c", None, "z"][i % 5 if i % 7 else 0]) for i in range(300)] + [(11, words(11, 11), "b")]
    got = mixing.mix(docs(spark, rows).withColumnRenamed("lang", "taken")).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = dict(zip(names, (3, 1, 2, 3, 1)))
    total, open_, target = 1.5 * sum(size.values()), set(names), {}
    while True:
        level = (total - sum(2 * size[s] for s in names if s not in open_)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            break
        open_ -= over
    target = {s: level * weight[s] if s in open_ else 2 * size[s] for s in names}
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == int(target[s] + 1e-9) for s in names)
    again = Counter((r["doc_id"], r["taken"]) for r in mixing.mix(docs(spark, rows[::-1]).repartition(7)).collect())
    assert again == Counter((r["doc_id"], r["taken"]) for r in got)


def test_mix_hot_id_and_many_sources(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice([7, 7, None, i]), words(rng.randint(0, 6), i), rng.choice(["a", "b", None, f"s{i % 9}"])) for i in range(400)]
    plain = Counter((r["doc_id"], r["text"], r["source"], r["target"], r["taken"]) for r in mixing.mix(docs(spark, rows)).collect())
    monkeypatch.setattr(mixing, "SOURCES", 2)
    many = mixing.mix(docs(spark, rows)).collect()
    target = {s: t for _, _, s, t, _ in plain}
    assert all(r["target"] == pytest.approx(target[r["source"]]) for r in many)
    monkeypatch.setattr(mixing, "ROWS", 4)  # ids that repeat far more often than that are cut by stored row
    got = mixing.mix(docs(spark, rows).repartition(5)).collect()
    taken, size, spans = Counter(), Counter(), defaultdict(list)
    for r in got:
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        if r["size"]:
            spans[r["source"]].append((r["first_word"], r["first_word"] + r["size"]))
    assert len(got) == len(rows) and all(taken[s] == int(target[s] + 1e-9) for s in target)
    for s, own in spans.items():  # every word of a source has one place
        own.sort()
        assert own[0][0] == 0 and own[-1][1] == size[s] and all(a[1] == b[0] for a, b in zip(own, own[1:]))


def test_mix_edges(spark):
    assert mixing.mix(docs(spark, EDGE)).count() == len(EDGE)
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(docs(spark, [(1, None, "a")])).collect()] == [0]


# op7


def slow_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_matches_definition():
    for t in (None, "", "One", "one TWO", "a b c", "É a\tb\x0bc D e", words(500, 1), "a " * 9):
        assert simhash.fingerprint((t or "").encode()) == slow_fingerprint(t)


def slow_components(ids, fps, k=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= k:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        r = find(i)
        low[r] = d if r not in low or low[r] is None else low[r] if d is None else min(low[r], d)
    return [low[find(i)] for i in range(len(fps))]


def flip(x, n, rng):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


@pytest.mark.parametrize("leaf,node", [(1024, 65_536), (8, 30), (4, 8)])
def test_links_lose_no_connection(spark, leaf, node):
    rng = random.Random(leaf)
    fps = [rng.getrandbits(64) for _ in range(60)]
    centre = rng.getrandbits(64)
    fps += [flip(centre, rng.randint(0, 6), rng) for _ in range(120)] + [flip(rng.choice(fps), rng.randint(0, 5), rng) for _ in range(60)]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash.link_fingerprints(df, leaf=leaf, node=node)
    for a, b in links.collect():
        assert a != b
    found = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    expect = slow_components(list(range(len(fps))), fps)
    got = [found.get(f, f) for f in signed]
    assert len({*zip(expect, got)}) == len(set(expect)) == len(set(got))


def test_close_pairs_is_complete():
    rng = random.Random(8)
    for n in (1, 2, 17, 300, 900):
        centre = rng.getrandbits(64)
        f = np.array([flip(centre, rng.randint(0, 9), rng) for _ in range(n)], np.uint64)
        g = f.copy()
        for s in (1, 2, 4, 8, 16, 32):
            g ^= g >> np.uint64(s)
        f = f[np.argsort(g)]
        got = {(int(i), int(j)) for a, b in simhash.close_pairs(f) for i, j in zip(a, b)}
        assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if bin(int(f[i] ^ f[j])).count("1") <= 3}


def test_tree_prunes_whole_groups():
    rng = np.random.default_rng(3)
    f = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 20_000, dtype=np.uint64)
    f[1::50] = f[::50] ^ np.uint64(1 << 40)
    g = f.copy()
    for s in (1, 2, 4, 8, 16, 32):
        g ^= g >> np.uint64(s)
    f = f[np.argsort(g)]
    seen = []
    got = sum(len(i) for i, _ in simhash.close_pairs(f, seen=seen))
    assert got >= 400
    leaves = [20_000 // 16**d for d in range(len(seen))]
    for (looked, kept), n in zip(seen, leaves):
        assert kept <= looked
    # Of all pairs of fingerprints few are ever compared: their groups were pruned above.
    assert seen[0][0] < 0.5 * 20_000**2 / 2


def test_keep_one_hot_rows_and_names(spark):
    text = words(30, 1)
    rows = [(5, text, "en", "s", 1)] * 400 + [(None, text, None, None, None), (5, text, "de", "s", 2), (7, words(30, 2), "en", None, 3)] + [(None, None, "x", "s", 0)] * 3 + [(None, "", "x", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component string, root long")
    got = simhash.keep_one(df).collect()
    assert simhash.keep_one(df).columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, 5), (False, 7), (True, 0)]
    assert all(tuple(r) in rows for r in got)
    assert Counter(tuple(r) for r in simhash.keep_one(df.repartition(7)).collect()) == Counter(tuple(r) for r in got)


def test_near_duplicates_end_to_end(spark):
    rng = random.Random(7)
    rows = []
    for g in range(25):
        base = words(rng.randint(40, 150), g).split()
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = "zz"
            rows.append((len(rows), " ".join(own), "s"))
    rows += [(r[0] + 1000 if r[0] is not None else None, r[1], "s") for r in EDGE[:6]]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    expect = slow_components([r[0] for r in rows], [slow_fingerprint(r[1]) for r in rows])
    assert Counter((r["doc_id"], r["component"]) for r in got) == Counter(zip((r[0] for r in rows), expect))
    kept = simhash.keep_one(docs(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter(set(expect))
    assert simhash.keep_one(docs(spark, [])).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (5, 4), (4, 5), (None, 1), (7, 8), (8, 9), (9, 10), (10, 11), (11, 6)] + [(100, i) for i in range(101, 160)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, **{i: 6 for i in range(6, 12)}, **{i: 100 for i in range(100, 160)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


# op8

TOXIC = ["blorgit", "snarfle", "quizzet", "dwimble", "hexfart"]


def toxic_corpus(n=900, seed=6):
    rng, rows = random.Random(seed), []
    pool = ["".join(rng.choices(["ta", "ne", "mo", "ri", "su", "la", "den", "kor"], k=rng.randint(1, 4))) for _ in range(300)]
    for i in range(n):
        w = rng.choices(pool, k=rng.randint(10, 80))
        bad = rng.random() < 0.2
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(TOXIC))
            w.insert(rng.randrange(len(w)), rng.choice(TOXIC))
        rows.append((i, " ".join(w), int(bad)))
    return rows


@pytest.fixture(scope="module")
def toxic_model(spark):
    rows = toxic_corpus()
    train = spark.createDataFrame(rows[:700], "doc_id long, text string, toxic int")
    return toxicity.train(train.select("doc_id", "text"), train.select("doc_id", "toxic"))


def test_toxicity_held_out_and_disguised(spark, toxic_model):
    model, lexicon = toxic_model
    rows = toxic_corpus()[700:]
    clean = next(t for _, t, y in rows if not y)
    forms = ["bl0rg1t", "b.l.o.r.g.i.t", "b l o r g i t", "snarfleeee", "$narfle", "hexf@rt", "dw1mble!!", "QUIZZET", "d-w-i-m-b-l-e"]
    more = [(10_000 + i, f"{clean} {f} {clean}", 1) for i, f in enumerate(forms)] + [(20_000, None, 0), (20_001, "", 0), (20_002, "12.5.2020 555-1234 a@b.com 04b0733c", 0)]
    df = spark.createDataFrame(rows + more, "doc_id long, text string, predicted int")
    got = {r["doc_id"]: r for r in toxicity.score_texts(df, model, lexicon, restore=True).collect()}
    assert len(got) == len(rows) + len(more) and all(0 <= r["score"] <= 1 for r in got.values())
    wrong = [(t, y) for i, t, y in rows + more if got[i]["predicted"] != y]
    assert len(wrong) <= 3, wrong
    assert "blorgit" in got[10_000]["restored"]


def test_toxicity_decode_is_the_best_path(toxic_model):
    model, _ = toxic_model
    for token in ("bl0rg1t", "sn4rfle", "qu1zz3t"):
        paths = {(0, 0, ""): 0.0}
        for choices in toxicity.lattice(token):
            after = {}
            for (a, b, w), s in paths.items():
                for ch, cost in choices:
                    c = toxicity.letter_class(ch) if ch else None
                    key = (b, c, w + ch) if ch else (a, b, w)
                    value = s + cost + (model.step(a, b, c) if ch else 0)
                    after[key] = max(after.get(key, -1e9), value)
            paths = after
        best = max((s + model.step(a, b, 0), w) for (a, b, w), s in paths.items() if w)
        assert toxicity.decode(token, model)[0] == best[1]


def test_toxicity_restores_whole_tokens():
    counts = np.zeros(64**3)
    for word, n in (("idiot", 400), ("ass", 300), ("poop", 300), ("some", 500), ("other", 500)):
        np.add.at(counts, common.trigrams(common.classes(f"{word}\n")), n)
    model = toxicity.CharModel(counts)
    restorer = toxicity.Restorer(model)
    forms = ["id10" + 70 * "o" + "t", "idi0" + 24 * "o" + "t", "1d10000000000t", "id" + 30 * "i1!" + "ot", "idi" + 50 * "o" + "t", "some-other-some-other-1d1" + 30 * "0" + "t", "-".join("id1" + 40 * "0o" + "t")]
    for form in forms:
        assert "idiot" in restorer.token(form), form
    assert "idiot" * 30 in restorer.token("1d10t" * 30)
    scorer = toxicity.Scorer(model, toxicity.Lexicon({"ass": 0.95, "poop": 0.95, "idiot": 0.95}, 0.01))
    for text in ("some a s s other", "some p o o p", "some p 0 0 p other", "I a s s", "i d i o t   a s s", "i d 1 0 t", *forms):
        assert scorer.score(text) >= 0.5, text
    for text in ("some other", "a b c", "a s s i", "p o s t", "555-1234 12.5.2020 1000000000000"):
        assert scorer.score(text) < 0.5, text


def test_toxicity_decode_of_random_tokens(toxic_model):
    """List Viterbi against all paths of short tokens, and against a plain dynamic program of long ones."""
    model, _ = toxic_model
    rng = random.Random(12)

    def value(path):
        score, a, b, w = 0.0, 0, 0, ""
        for ch, cost in path:
            score += cost
            if ch:
                c = toxicity.letter_class(ch)
                score, a, b, w = score + model.step(a, b, c), b, c, w + ch
        return (score + model.step(a, b, 0), w) if w else (-1e18, "")

    from itertools import product

    for _ in range(150):
        token = "".join(rng.choices("abdeilorst01345@$!.-|(", k=rng.randint(1, 9)))
        best = max((value(p) for p in product(*toxicity.lattice(token))), default=(-1e18, ""))
        got = toxicity.decode(token, model)
        assert (got[0] if got else "") == best[1], token
    for _ in range(30):
        token = "".join(rng.choices("abdeilorst01345@$!.-|(", k=rng.randint(60, 200)))
        states = {(0, 0): (0.0, "")}
        for choices in toxicity.lattice(token):
            after = {}
            for (a, b), (s, w) in states.items():
                for ch, cost in choices:
                    c = toxicity.letter_class(ch) if ch else 0
                    key, x = ((b, c), (s + cost + model.step(a, b, c), w + ch)) if ch else ((a, b), (s + cost, w))
                    after[key] = max(after.get(key, (-1e18, "")), x)
            states = after
        best = max((s + model.step(a, b, 0), w) for (a, b), (s, w) in states.items() if w)
        again = toxicity.decode(token, model)[0]
        assert len(again) == len(best[1]) and sum(x != y for x, y in zip(again, best[1])) <= 1, token


def test_toxicity_pieces(spark, toxic_model):
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("ab\u00e9\U0001f600", k=rng.randint(1, 9))) for _ in range(3_000)) + "  \n x y z " + "q" * 500
    for size in (7, 64, 1_000):
        own = [*toxicity.pieces(text.encode(), size)]
        assert "".join(own) == text and len(own) > 3
        assert {w for p in own for w in p.split()} == set(text.split())
        assert not any(p[-2:].strip() and len(p.split()[-1]) == 1 for p in own[:-1])
    assert [*toxicity.pieces(b"")] == [""]
    model, lexicon = toxic_model
    scorer = toxicity.Scorer(model, lexicon)
    long = words(400_000, 4) + " b l o r g i t sn4rfle " + words(400_000, 5)
    assert scorer.score(long) >= 0.5 > scorer.score(words(400_000, 4)) and scorer.score("") == pytest.approx(lexicon.base)


def test_toxicity_brute_force_score(toxic_model):
    """Scores are the noisy or of the best feature of every restored token, whatever memory and pieces do."""
    model, lexicon = toxic_model
    restorer = toxicity.Restorer(model)

    def slow(text):
        said = {}
        for token in (text or "").lower().split():
            found = [(p, w) for w in restorer.token(token) for p, _ in [lexicon.word(w)] if p]
            if found:
                said[max(found)[1]] = max(found)[0]
        left = 1 - lexicon.base
        for p in said.values():
            left *= 1 - p
        return 1 - left

    scorer = toxicity.Scorer(model, toxicity.Lexicon({f: p for f, p in lexicon.weights.items() if not f.endswith("2")}, lexicon.base))
    lexicon = scorer.lexicon
    for _, text, _ in toxic_corpus(150, 9):
        leet = text.replace("o", "0").replace("i", "1")
        for t in (text, leet):
            assert scorer.score(t) == pytest.approx(slow(t))


def test_toxicity_empty(spark, toxic_model):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score_texts(empty, *toxic_model).collect() == []
    model, lexicon = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert lexicon.weights == {} and 0 <= toxicity.Scorer(model, lexicon).score("any text") < 0.5


# op9


def slow_contamination(text, items, width=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, names = cut(text), set(), set()
    for name, t in items:
        own = cut(t)
        for i in range(max(1, len(own) - width + 1) if own else 0):
            window = own[i : i + width]
            for j in range(len(w) - len(window) + 1):
                if w[j : j + len(window)] == window:
                    hit |= {*range(j, j + len(window))}
                    names.add(name)
    return len(w), len(hit), sorted(str(n) for n in names if n is not None)


@pytest.mark.parametrize("block, most", [(8_000_000, 1_000_000), (150, 1_000_000), (60, 12), (8_000_000, 14)])
def test_contamination_against_brute_force(spark, block, most):
    items = [(1, words(30, 1)), (2, "Short item"), (10, words(12, 3)), (11, words(12, 3)), (None, "null name here"), (12, None), (13, " -- "), (14, "Été çà"), (1, words(30, 1))]
    texts = [words(40, 9) + " " + words(30, 1) + " x", "a SHORT, item! short item", words(12, 3).upper().replace(" ", "-"), " ".join(words(30, 1).split()[5:16]), "null name here", "", None, "Été çà!", "shortitem short"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(docs(spark, rows).withColumnRenamed("lang", "items"), bench, block=block, most=most).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, names = slow_contamination(r["text"], items)
        assert (r["n_words"], sum(s["last"] - s["first"] for s in r["spans"]), r["items"]) == (n, hit, names)
        if r["text"]:
            whole = decontamination.words(r["text"].encode())
            for s in r["spans"]:
                part = r["text"][s["from"] : s["to"]]
                assert decontamination.words(part.encode()) == whole[s["first"] : s["last"]] and part == part.strip(" ,!")
    assert decontamination.contaminated(docs(spark, []), bench).collect() == []
    assert all(r["spans"] == [] for r in decontamination.contaminated(docs(spark, rows), bench.where("false")).collect())


def test_contamination_long_text(spark):
    long = " ".join(f"w{i % 5_003} \u00e9" for i in range(300_000))
    own = long.split()[400_000:400_012]
    bench = spark.createDataFrame([("a", " ".join(own))], "item_id string, text string")
    got = decontamination.contaminated(docs(spark, [(1, long, "s")]), bench).first()
    n, hit = len(long.split()), sum(s["last"] - s["first"] for s in got["spans"])
    assert got["n_words"] == n and hit >= 12 and got["items"] == ["a"]
    assert all(" ".join(own[:10]) in long[s["from"] : s["to"]] or " ".join(own[1:11]) in long[s["from"] : s["to"]] for s in got["spans"])


# op10


def test_shard_exact_sizes_and_slots(spark):
    for n in (0, 1, 15, 1003):
        rows = [(i % 400, "same" if i % 3 == 0 else words(5, i), "s") for i in range(n)]
        got = sharding.shard(docs(spark, rows).withColumnRenamed("lang", "slot")).collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows)
        by = defaultdict(list)
        for r in got:
            by[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(16))
        assert not n or max(len(by[s]) for s in range(16)) - min(len(by[s]) for s in range(16)) <= 1


def test_hypergeometric_draws():
    rng = np.random.default_rng(1)
    for good, bad, sample in ((5, 7, 6), (1, 30, 4), (300, 200, 100)):
        draws = np.array([sharding.draw_hypergeometric(rng, good, bad, sample) for _ in range(4000)])
        assert draws.min() >= max(0, sample - bad) and draws.max() <= min(good, sample)
        mean = sample * good / (good + bad)
        spread = (mean * bad / (good + bad) * (good + bad - sample) / (good + bad - 1)) ** 0.5
        assert abs(draws.mean() - mean) < 5 * spread / 4000**0.5 and abs(draws.std() - spread) < 0.1 * spread + 0.02
    matrix = sharding.communication_matrix([10, 0, 33, 7], 6, 3)
    assert [sum(r) for r in matrix] == [10, 0, 33, 7] and sorted(map(sum, zip(*matrix))) == [8, 8, 8, 8, 9, 9]


def test_shard_spreads_evenly(spark):
    rows = [(i, "t", "s") for i in range(3200)]
    got = {r["doc_id"]: r["shard"] for r in sharding.shard(docs(spark, rows)).collect()}
    for start in (0, 800, 1600, 2400):
        count = Counter(got[i] for i in range(start, start + 800))
        assert sum((count[s] - 50) ** 2 / 50 for s in range(16)) < 45


def test_id_crc(spark):
    got = [r[0] for r in spark.createDataFrame([(5,), (None,)], "doc_id long").select(common.id_crc("doc_id")).collect()]
    assert got == [zlib.crc32(b"5"), 0]
