"""Toxicity by noisy-channel deobfuscation.

Every text is restored first: tokens that look disguised (digits or signs among letters, letters spaced out, letters
repeated) become a lattice of characters, and a Viterbi search under a character language model, whose counts come from
all documents, finds the likeliest plain words (the two best different readings of a token count). The restored text is then scored by a lexicon of words and word stems that
is learned from labelled texts, restored in the same way. Texts are read in pieces cut between words, so a long one is never held as words all at once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import BLOCK, N_GRAMS, classes, decode_blocks, id_crc, load, materialize, text_blocks, text_bytes, trigrams

#: Labelled documents that the lexicon is fitted on, at most, chosen by a hash of their id; their texts are read whole, and all text statistics cover all documents.
MAX_LABELLED = 8_000
#: Tasks, at most, that read the labelled texts; their number is bounded, so this is too.
TASKS = 48

#: What a sign or digit may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "[": "c", "{": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "#": "h", "%": "x",
    "*": "aeiou", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i",
}
#: Tokens up to this length are remembered with what was found in them.
SHORT = 64
_SUBSTITUTE, _DROP, _REPEAT = -1.0, -1.5, -0.7

_EDGES = " \t\n\r\v\f.,;:?\"'`“”„«»‚‘’()[]{}<>…·—–-_/\\=~^&%#*+|!$@"
_LETTERS = re.compile(r"[^\W\d_]+")
#: Letters next to digits or signs inside a token.
_MIXED = re.compile(r"[^\W\d_].*[\d@$!|+(\[{<€£¥#%*._\-'~^=/\\].*[^\W\d_]|[\d@$!|][\d@$!|]*[^\W\d_]|[^\W\d_][\d@$!|]|[аеорсухі].*[a-z]|[a-z].*[аеорсухі]", re.S)
_LEAD, _TRAIL = set("$@!|+#(€£0123456789"), set("$@|+€£0123456789")
_TRIPLE = re.compile(r"(.)\1\1")
_SAME = re.compile(r"(.)\1{2,}", re.S)
_PRIME = (1 << 61) - 1
_DOUBLE = re.compile(r"(.)\1")
_RUN = re.compile(r"(.)\1+")
_PARTS = re.compile(r"[^\w@$!|+]+|_+")
#: Three or more single characters parted by blanks.
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+€£¥])(?:[ \t]{1,3}(?:[^\W_]|[@$!|+€£¥])){2,}(?![^\W_])")
_GAP = re.compile(r"[ \t]{2,}")
#: White space between two longer words, where no disguised word can be cut.
_CUT = re.compile(r"(?<=\S\S)\s+(?=\S\S)")


def pieces(text: bytes | memoryview, size: int = BLOCK) -> Iterator[str]:
    """A UTF-8 text in pieces of about size bytes, cut where neither a word nor a run of spaced letters goes on; a stretch without such a place stays whole."""
    if len(text) <= size:
        yield str(text, "utf-8", "replace")
        return
    carry = ""
    for part in decode_blocks(text, size):
        carry += part
        cut = 0
        for m in _CUT.finditer(carry, max(0, len(carry) - 4096)):
            cut = m.end()
        if cut:
            yield carry[:cut]
            carry = carry[cut:]
    yield carry


class CharModel:
    """Letter trigram model; letters outside a-z have shared classes."""

    def __init__(self, counts: np.ndarray, smooth: float = 0.05):
        cube = counts.reshape(64, 64, 64).astype(np.float64)
        pair = cube.sum(axis=2, keepdims=True)
        single = cube.sum(axis=(0, 1)) + 1.0
        single /= single.sum()
        second = cube.sum(axis=0)
        second = (second + 20 * single) / (second.sum(axis=1, keepdims=True) + 20)
        self.logp = np.log((cube + 5 * second + smooth * single) / (pair + 5 + smooth)).astype(np.float32)

    def step(self, a: int, b: int, c: int) -> float:
        return float(self.logp[a, b, c])


@lru_cache(4096)
def letter_class(ch: str) -> int:
    return int(classes(ch)[0]) if ch else 0


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Choices of each character: letters with a channel cost; the empty choice drops it (separators and repeats)."""
    out = []
    for i, ch in enumerate(token):
        low = ch.lower()
        choices: list[tuple[str, float]] = []
        if low.isalpha() and low not in LEET:
            choices.append((low[0], 0.0))
        for x in LEET.get(low, ""):
            choices.append((x, _SUBSTITUTE))
        if not low.isalnum():
            choices.append(("", _DROP))
        if i and low == token[i - 1].lower():
            choices.append(("", _REPEAT))
        out.append(choices or [("", _DROP)])
    return out


def shorten(token: str, tight: bool = False) -> str:
    """token with runs of three or more of a sign cut to two, also runs of signs that stand for the same letter; tight: mixed runs become one sign."""
    token = _SAME.sub(r"\1\1", token)
    if token.isalpha():
        return token
    out: list[str] = []
    run: list[str] = []
    common: set[str] = set()
    sets: set[frozenset] = set()

    def flush() -> None:
        mixed = len(set(run)) > 1
        if mixed and (tight or len(sets) == 1 or len(run) > 3):
            out.append((next(iter(common)) if len(common) == 1 else run[0]) * (1 if tight else 2))
        else:
            out.extend(run)

    for ch in token:
        own = frozenset(LEET.get(ch, ch if ch.isalpha() else ""))
        if common & own:
            run.append(ch)
            common, sets = common & own, sets | {own}
        else:
            flush()
            run, common, sets = [ch], set(own), {own}
    flush()
    return _SAME.sub(r"\1\1", "".join(out))


def decode(token: str, model: CharModel, best: int = 2) -> list[str]:
    """The likeliest plain words of a token, by Viterbi over its lattice in one pass: states are the last two letters, all are kept.

    A path is (score, hash of its letters, (path before, letter)), so that long tokens take linear time.
    """
    states: dict[tuple[int, int], list[tuple]] = {(0, 0): [(0.0, 0, None)]}
    for choices in lattice(token):
        marked = [(ch, letter_class(ch), ord(ch) if ch else 0, cost) for ch, cost in choices]
        after: dict[tuple[int, int], list[tuple]] = {}
        for (a, b), paths in states.items():
            for ch, c, code, cost in marked:
                if ch:
                    gain = cost + model.step(a, b, c)
                    after.setdefault((b, c), []).extend((s + gain, (h * 1_000_003 + code) % _PRIME, (w, ch)) for s, h, w in paths)
                else:
                    after.setdefault((a, b), []).extend((s + cost, h, w) for s, h, w in paths)
        # The best few different paths of each state (list Viterbi).
        states = {k: _first(v, best) for k, v in after.items()}
    ends = _first([(s + model.step(a, b, 0), h, w) for (a, b), paths in states.items() for s, h, w in paths if w], best)
    return list(dict.fromkeys(_spell(w) for _, _, w in ends))


def _first(paths: list[tuple], best: int) -> list[tuple]:
    if len(paths) == 1:
        return paths
    found: dict[int, tuple] = {}
    for p in sorted(paths, key=lambda p: (-p[0], p[1])):
        found.setdefault(p[1], p)
        if len(found) == best:
            break
    return [*found.values()]


def _spell(path: tuple | None) -> str:
    letters = []
    while path:
        path, ch = path
        letters.append(ch)
    return "".join(reversed(letters))


def squeeze(word: str) -> str:
    return _RUN.sub(r"\1", word)


class Restorer:
    """Words of a text as written and as restored."""

    def __init__(self, model: CharModel):
        self.model = model

    def token(self, token: str) -> tuple[str, ...]:
        """Plain words that a token (without white space) may stand for; the words as written come first."""
        low = token.lower()
        if low.isalpha():
            bare, own = low, [low]
        else:
            bare = low.strip(_EDGES)
            own = [bare] if bare.isalpha() else _LETTERS.findall(low)
        more: list[str] = []
        if bare.isalpha():
            if len(_DOUBLE.findall(bare)) > 1:
                more.append(squeeze(bare))
            if _TRIPLE.search(bare):
                more += self.plain(bare)
            if len(bare) + 1 == len(low) and (low[0] in _LEAD or low[-1] in _TRAIL):
                more += self.plain(low)
        elif bare and (len(low) > 64 or _MIXED.search(bare)):
            at = low.index(bare)
            if at == 1 and low[0] in _LEAD:
                bare = low[0] + bare
            if at + len(bare) == len(low) - 1 and low[-1] in _TRAIL:
                bare += low[-1]
            more += self.plain(bare)
            if len(bare) > 24:
                # Separators may also part words: each part, and single signs in a row, are looked at as a word too.
                parts = _PARTS.split(bare)
                runs = ["".join(g) for single, g in groupby(parts, lambda x: len(x) == 1) if single]
                for part in dict.fromkeys([*(x for x in parts if len(x) > 2), *runs, "".join(x for x in parts if len(x) == 1)]):
                    if part != bare and len(part) > 2 and (part.isalpha() or len(part) > 64 or _MIXED.search(part)):
                        more += [part, *self.plain(part)] if part.isalpha() else self.plain(part)
        return tuple(dict.fromkeys([*own, *more]))

    def plain(self, token: str) -> list[str]:
        """The likeliest plain words of a whole token of any length, repeated signs shortened first; none without a letter or sign for one."""
        return [w for form in dict.fromkeys((shorten(token), shorten(token, True))) for w in decode(form, self.model)]

    def spaced(self, text: str) -> dict[str, list[str]]:
        """Runs of single characters, parted by blanks, joined, each with the words it may stand for: the run, its parts between wider gaps, and these without a leading a or i."""
        out: dict[str, list[str]] = {}
        for m in _SPACED.finditer(text):
            low = m[0].lower()
            run = "".join(low.split())
            parts = [x for x in ("".join(p.split()) for p in _GAP.split(low)) if len(x) > 2]
            forms = dict.fromkeys([run, *parts])
            forms |= dict.fromkeys(x[1:] for x in list(forms) if x[0] in "ai" and len(x) > 3)
            out.setdefault(run, []).extend(w for x in forms for w in [x, *self.plain(x)])
        return out

    def words(self, text: bytes | memoryview, memory: dict[str, tuple[str, ...]]) -> set[str]:
        """Distinct words of the tokens of a whole text, as written and restored; memory keeps those of short tokens."""
        out: set[str] = set()
        for piece in pieces(text):
            for token in set(piece.lower().split()):
                if (found := memory.get(token)) is None:
                    found = self.token(token)
                    if len(token) <= SHORT:
                        if len(memory) > 100_000:
                            memory.clear()
                        memory[token] = found
                out.update(found)
        return out

    def restore(self, text: str) -> str:
        """text with its disguised words replaced by their likeliest plain forms."""
        text = _SPACED.sub(lambda m: "".join(m[0].split()), text)

        def plain(m):
            found = self.token(m[0])
            bare = m[0].strip(_EDGES).lower()
            other = [w for w in found if w != bare]
            if bare.isalpha() and not _TRIPLE.search(bare) or not other:
                return m[0]
            return next((w for w in decode(shorten(bare or m[0]), self.model)), m[0])

        return re.sub(r"\S+", plain, text)


def stems(word: str) -> list[str]:
    """Stems of 4 to 7 letters, marked by a dash."""
    return [word[:n] + "-" for n in range(4, min(8, len(word)))]


def doc_features(words: set[str], stems_of: set[str]) -> set[str]:
    """Words, stems (stem-) and stems that two different words have (stem-2); of stems only those asked for."""
    out, count = set(words), Counter()
    for w in words:
        count.update(f for f in stems(w) if f in stems_of)
    out.update(count)
    out.update(f + "2" for f, n in count.items() if n > 1)
    return out


class Lexicon:
    """Probability that a text is toxic given that it has a feature; the features of a text combine by noisy or."""

    def __init__(self, weights: dict[str, float], base: float):
        self.weights, self.base = dict(weights), base
        for f, p in weights.items():
            if "-" not in f and squeeze(f) != f:
                self.weights.setdefault(squeeze(f), p)
        self.lengths = sorted({f.index("-") for f in weights if "-" in f})
        self.heads = {f[:3] for f in self.weights}
        self.inside = [(f.rstrip("-2"), p) for f, p in self.weights.items() if len(f.rstrip("-2")) >= 4 and p >= 0.5]

    def word(self, word: str) -> tuple[float, tuple[str, ...]]:
        """What a word adds by itself, and its stems that count when two words have them."""
        if word[:3] not in self.heads:
            return 0.0, ()
        get = self.weights.get
        p, pairs = get(word, 0.0), []
        for n in self.lengths:
            if len(word) > n:
                stem = word[:n] + "-"
                p = max(p, get(stem, 0.0))
                if stem + "2" in self.weights:
                    pairs.append(stem + "2")
        return p, tuple(pairs)


class Scorer:
    """Scores texts; what a token adds is remembered, up to `remember` tokens."""

    def __init__(self, model: CharModel, lexicon: Lexicon, remember: int = 150_000):
        self.restorer, self.lexicon, self.remember, self.memory = Restorer(model), lexicon, remember, {}

    def token(self, token: str):
        """None for a token that says nothing, else (probability, word, stems that count in pairs)."""
        out = self.best(self.restorer.token(token))
        if len(token) <= SHORT:
            if len(self.memory) >= self.remember:
                self.memory.clear()
            self.memory[token] = out
        return out

    def best(self, words):
        found = [(p, w, pairs) for w in words for p, pairs in [self.lexicon.word(w)] if p or pairs]
        return max(found) if found else None

    def score(self, text: str | bytes | memoryview) -> float:
        known, unknown = self.memory.get, ()
        said: dict[str, tuple] = {}
        inside: dict[str, float] = {}
        for piece in pieces(text.encode("utf-8", "replace") if isinstance(text, str) else text):
            singles = 0
            for t in set(piece.lower().split()):
                x = known(t, unknown)
                if x is unknown:
                    x = self.token(t)
                if x is not None:
                    said[x[1]] = x
                if len(t) == 1:
                    singles += 1
            for run, words in (self.restorer.spaced(piece) if singles else {}).items():
                x = self.best(words)
                if x is not None:
                    said[x[1]] = x
                p = max((p for f, p in self.lexicon.inside if f in run), default=0.0)
                if p > (x[0] if x else 0.0):
                    inside[run] = p
        clean, pairs = 1.0 - self.lexicon.base, Counter()
        for p, _, own in said.values():
            clean *= 1.0 - p
            pairs.update(own)
        for f, n in pairs.items():
            if n > 1:
                clean *= 1.0 - self.lexicon.weights[f]
        for p in inside.values():
            clean *= 1.0 - p
        return min(1.0, max(0.0, 1.0 - clean))


def labelled_words(df: DataFrame, model: CharModel) -> DataFrame:
    """df (__text, __label) -> (key, label, marks, words): hash and sketch of each whole text, and its distinct words as written and restored."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, memory = Restorer(sent.value), {}
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for i in range(batch.num_rows):
                raw = text_bytes(texts, i)
                key = xxhash.xxh64_intdigest(raw)
                row = [pa.array([key - (1 << 64) if key >> 63 else key]), batch.column(1).slice(i, 1), pa.array([sketch(raw)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*row, pa.array([sorted(restorer.words(raw, memory))], pa.list_(pa.string()))], names=["key", "label", "marks", "words"])

    return df.select("__text", "__label").mapInArrow(run, "key long, label int, marks array<long>, words array<string>")


def learn_lexicon(rows: DataFrame, limit: int = MAX_LABELLED, least: float = 0.004, precision: float = 0.9) -> Lexicon:
    """Greedy cover of the toxic texts by features that hardly occur in clean ones. rows: see labelled_words.

    A feature needs `least` of the toxic texts (5 at least) and `precision`; near copies of a text count once. Words are counted on the executors; the driver
    gets the sketches, words and stems that enough toxic texts have, and for these the texts that have them.
    """
    spark = rows.sparkSession
    seen: set = set()
    kept: list[tuple[int, int]] = []
    for r in rows.select("key", "label", "marks").orderBy("key", "label").limit(limit).collect():
        marks = {*enumerate(r["marks"])}
        if marks.isdisjoint(seen):
            kept.append((r["key"], r["label"]))
        seen |= marks
    n_pos = sum(label for _, label in kept)
    need = max(5, math.ceil(least * n_pos))
    base = min(0.3, (n_pos * 0.02 + 0.5) / (len(kept) + 1))
    if not n_pos:
        return Lexicon({}, base)
    few = spark.createDataFrame([(i, *x) for i, x in enumerate(kept)], "row int, key long, label int")
    rows = rows.join(F.broadcast(few), ["key", "label"]).dropDuplicates(["row"])
    counts = rows.where("label = 1").select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    common_words = {r["word"] for r in counts.where(F.col("n") >= need).collect()}
    # Sums of word counts come first: a stem whose words are rare among toxic texts needs no exact count.
    stem = F.explode(F.transform(F.sequence(F.lit(4), F.least(F.lit(7), F.length("word") - 1)), lambda n: F.concat(F.substring(F.col("word"), F.lit(1), n), F.lit("-"))))
    sums = counts.where(F.length("word") > 4).select(stem.alias("stem"), "n").groupBy("stem").agg(F.sum("n").alias("n"))
    likely = {r["stem"] for r in sums.where(F.col("n") >= need).collect()}
    heads = {f[:3] for f in likely | common_words}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for words in batch.column(2):
                own = doc_features({w for w in map(str, words) if w[:3] in heads}, likely)
                found.append([f for f in own if "-" in f or f in common_words])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["row", "label", "features"])

    found = rows.select("row", "label", "words").coalesce(TASKS).mapInArrow(features, "row int, label int, features array<string>")
    found = materialize(found.select("row", "label", F.explode("features").alias("feature")), "toxic-features")
    tally = found.groupBy("feature").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).where(F.col("pos") >= need).collect()
    wrong = {r["feature"]: r["neg"] for r in tally}
    # Only features of which few clean texts hold a word can count; the others' texts stay where they are.
    sure = [r["feature"] for r in tally if r["pos"] / (r["pos"] + r["neg"]) >= precision]
    rate = {r["feature"]: (r["pos"] + 0.05) / (r["pos"] + r["neg"] + 0.1) for r in tally}
    holders: dict[str, set[int]] = {f: set() for f in sure}
    if sure:
        named = spark.createDataFrame([(f,) for f in sure], "feature string")
        for r in found.where("label = 1").join(F.broadcast(named), "feature").select("feature", "row").collect():
            holders[r["feature"]].add(r["row"])
    return Lexicon(cover(holders, wrong, rate, len(kept), need, precision), base)


def cover(holders: dict[str, set[int]], wrong: dict[str, int], rate: dict[str, float], n_rows: int, need: int, precision: float) -> dict[str, float]:
    """Weights of chosen features. holders: toxic texts by feature, of sure features; wrong and rate: clean texts and smoothed precision of all features that `need` toxic texts have."""
    weights: dict[str, float] = {}
    left = set(range(n_rows))
    specific = lambda f: 1 - 0.5 ** (f.index("-") - 1) if "-" in f else 1.0
    order = set(holders)
    while order:
        gain = {f: len(holders[f] & left) for f in order}
        order = {f for f in order if gain[f] >= need}
        if not order:
            break
        best = max(order, key=lambda f: (gain[f] * rate[f] ** 8 * specific(f), len(holders[f]), len(f), f))
        weights[best] = min(0.995, rate[best])
        left -= holders[best]
        order.remove(best)
    # Sure words that a chosen feature already covers stay as evidence of their own; likely stems of chosen pairs are weak evidence.
    chosen = set(weights)
    for f in holders:
        if "-" not in f and wrong[f] == 0 and (len(holders[f]) >= 4 * need or any(w + "2" in chosen for w in stems(f))):
            weights.setdefault(f, min(0.995, rate[f]))
    unsure = []
    for f in chosen:
        if f.endswith("-2") and rate.get(f[:-1], 0.0) >= 0.5:
            weights.setdefault(f[:-1], 0.25 if rate[f[:-1]] < precision else min(0.995, rate[f[:-1]]))
        if f.endswith("-2") and rate.get(f[:-1], 0.0) < precision:
            unsure.append(f[:-2])
    # A word whose stem also occurs in clean texts is no proof by itself, however it fell in the sample.
    for f in weights:
        if "-" not in f and f.startswith(tuple(unsure)):
            weights[f] = min(weights[f], 0.4)
    return weights


def sketch(text: bytes | memoryview, width: int = 3) -> list[int]:
    """Four minima of hashes of the three-word shingles: near copies share one of them, other texts hardly ever do."""
    best = [(1 << 64) - 1] * 4
    tail: list[str] = []
    for piece in pieces(text):
        words = tail + piece.lower().split()
        for a in range(0, max(len(words) - width + 1, 0), 1 << 16):
            shingles = (" ".join(words[i : i + width]) for i in range(a, min(a + (1 << 16), len(words) - width + 1)))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64)
            best = [min(b, int((hashes * np.uint64(2 * k * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1)).min())) for k, b in enumerate(best)]
        tail = words[-(width - 1) :]
    if best[0] == (1 << 64) - 1:  # fewer words than a shingle
        best = [xxhash.xxh64_intdigest(" ".join(tail), k) for k in range(4)]
    return [x - (1 << 64) if x >> 63 else x for x in best]


def char_model(df: DataFrame, text: str = "text") -> CharModel:
    """Letter trigrams counted over all texts of df; each task sends one row per trigram, at most 2^18 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_GRAMS, np.int64)
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for a, b in text_blocks(texts):
                if b - a > 1:
                    total += np.bincount(trigrams(classes("\n\n".join(str(text_bytes(texts, i), "utf-8", "replace") for i in range(a, b)))), minlength=N_GRAMS)
                    continue
                tail = np.zeros(2, np.uint8)
                for part in decode_blocks(text_bytes(texts, a)):
                    joined = np.concatenate((tail, classes(part)))
                    total += np.bincount(trigrams(joined)[2:], minlength=N_GRAMS)
                    tail = joined[-2:]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    table = df.select(text).where(F.col(text).isNotNull()).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(N_GRAMS)
    counts[table.column("gram").to_numpy()] = table.column("n").to_numpy()
    return CharModel(counts)


def train(docs: DataFrame, labels: DataFrame, ids: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = MAX_LABELLED) -> tuple[CharModel, Lexicon]:
    """Character model of all docs; lexicon of at most `limit` labelled documents, chosen by a hash of the id. Null labels, ids and texts are left out; of a repeated label the largest counts."""
    model = char_model(docs, text)
    marked = labels.where(F.col(label).isNotNull() & F.col(ids).isNotNull()).groupBy(F.col(ids).alias("__id")).agg((F.max(label) > 0).cast("int").alias("__label"))
    own = docs.select(F.col(ids).alias("__id"), F.col(text).alias("__text")).where("__text IS NOT NULL")
    chosen = marked.join(own.select("__id"), "__id", "left_semi").orderBy(F.xxhash64("__id"), "__id").limit(limit)
    # At most `limit` short rows are sent to find the texts, which a bounded number of tasks then reads.
    rows = own.join(F.broadcast(chosen), "__id").select("__text", "__label").distinct().coalesce(TASKS)
    return model, learn_lexicon(materialize(labelled_words(rows, model), "labelled-words"), limit)


def score_texts(df: DataFrame, model: CharModel, lexicon: Lexicon, text: str = "text", restore: bool = False, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with `score` (0 to 1) and `predicted` (1 from 0.5 on); with restore, `restored` has the text with disguised words plain.

    Only the text is read, and all of it. Null and empty texts get the base rate of the lexicon. No row is dropped, repeated rows
    stay, an empty df gives an empty result; clashing columns are replaced.
    """
    added = ["score", "predicted"] + ["restored"] * restore
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in added]
    at = names.index(text) if text in names else len(names)
    own = df.select(*names) if text in names else df.select(*names, F.col(text).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[: len(names)]] + ["score double, predicted int"] + ["restored string"] * restore)
    sent = df.sparkSession.sparkContext.broadcast((model, lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            scores = [scorer.score(text_bytes(texts, i)) for i in range(batch.num_rows)]
            more = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            if restore:
                more.append(pa.array([scorer.restorer.restore(t.as_py()) if t.is_valid else None for t in batch.column(at)], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *more], names=[*names, *added])

    return own.mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(id_crc("doc_id"), F.lit(5)) == 0
    labels = load(spark, sf_dir, "labels").where(~held_out)
    model, lexicon = train(docs, labels)
    return score_texts(docs, model, lexicon, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")
