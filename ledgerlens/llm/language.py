"""Multilingual language identification: expectation-maximisation of a document's language proportions.

Each language is a letter trigram model counted over all training documents; a trigram is three lower-case code points hashed to 18 bits, so
scripts keep their letters apart. A text is cut into segments of 80 code points; a segment's log likelihood under each language comes from its
trigrams. EM estimates the proportions of the languages in the document, and the set of languages is the one of largest likelihood less `penalty`
per language, by backward elimination. Texts stream through in blocks, so what is held of a long one is its segments' likelihoods.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import BLOCK, N_GRAMS, decode_blocks, fresh, id_crc, letter_codes, load, materialize, text_blocks, text_bytes

#: Up to this many languages the model is a dense table (1 MB each); beyond that only the seen (trigram, language) pairs are held. Results agree.
DENSE_LANGUAGES = 64
#: Segments that one EM step holds.
ROWS = 1 << 16
SEGMENT = 80
UND = "und"


def grams(codes: np.ndarray) -> np.ndarray:
    """18-bit hash of each code triple; the first two codes are context only, so the result is two shorter."""
    c = codes.astype(np.uint32)
    h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(14)).astype(np.int32)


def decoded(text: bytes | memoryview, size: int = BLOCK) -> Iterator[np.ndarray]:
    """Letter codes of a UTF-8 text, in blocks of about size bytes."""
    return map(letter_codes, decode_blocks(text, size))


def count_trigrams(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows with a text and a language; each task sends one row per language and trigram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        gap = np.zeros(2, np.uint32)
        for batch in batches:
            texts, langs = batch.column(0).cast(pa.binary()), batch.column(1).to_pylist()
            held: dict[str, list[np.ndarray]] = {}
            sizes: dict[str, int] = {}

            def add(name: str, codes: np.ndarray) -> None:
                total = counts.setdefault(name, np.zeros(N_GRAMS, np.int64))
                total += np.bincount(grams(codes)[codes[2:] > 0], minlength=N_GRAMS)

            for i, name in enumerate(langs):
                data = text_bytes(texts, i)
                if len(data) <= BLOCK:  # short texts are counted together, parted by two codes that are no letters
                    for codes in decoded(data):
                        held.setdefault(name, []).extend((gap, codes))
                        sizes[name] = sizes.get(name, 0) + len(codes)
                    if sizes[name] >= BLOCK:
                        add(name, np.concatenate(held.pop(name)))
                        sizes[name] = 0
                    continue
                tail = gap
                for codes in decoded(data):
                    joined = np.concatenate((tail, codes))
                    add(name, joined)
                    tail = joined[-2:]
            for name, parts in held.items():
                add(name, np.concatenate(parts))
        for name, total in counts.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "gram", "n"])

    rows = df.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    return rows.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Log probability of each trigram by language; add-`smooth` over the trigrams seen in any language.

    counts: (language number, gram, n) triples as three arrays.
    """

    def __init__(self, langs: list[str], counts: tuple[np.ndarray, np.ndarray, np.ndarray], smooth: float = 0.5, dense: int | None = None):
        self.langs = langs
        k, g, n = counts
        seen = max(1, len(np.unique(g)))
        totals = np.bincount(k, weights=n, minlength=len(langs))
        self.base = np.log(smooth / (totals + smooth * seen)).astype(np.float32)
        value = np.log((n + smooth) / (totals[k] + smooth * seen)).astype(np.float32)
        self.logp = None
        if len(langs) <= (DENSE_LANGUAGES if dense is None else dense):
            self.logp = np.repeat(self.base[:, None], N_GRAMS, axis=1)
            self.logp[k, g] = value
        else:
            order = np.argsort(g, kind="stable")
            self.first = np.searchsorted(g[order], np.arange(N_GRAMS + 1)).astype(np.int64)
            self.lang, self.gain = k[order].astype(np.int32), (value - self.base[k])[order]

    def likelihoods(self, g: np.ndarray, letters: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Segments x languages: log likelihood of the letters (0 or 1 by position) of each segment, given where segments start."""
        out = np.empty((len(starts), len(self.langs)), np.float32)
        if self.logp is not None:
            for k in range(len(self.langs)):
                out[:, k] = np.add.reduceat(self.logp[k][g] * letters, starts)
            return out
        np.outer(np.add.reduceat(letters.astype(np.float32), starts), self.base, out=out)
        segment = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(g)]))
        for a in range(0, len(starts), 256):
            at = np.flatnonzero((segment >= a) & (segment < a + 256) & letters)
            size = self.first[g[at] + 1] - self.first[g[at]]
            place = np.repeat(self.first[g[at]] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            cell = np.repeat(segment[at] - a, size) * len(self.langs) + self.lang[place]
            rows = min(256, len(starts) - a)
            out[a : a + rows] += np.bincount(cell, weights=self.gain[place], minlength=rows * len(self.langs)).reshape(rows, -1)
        return out


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Model of the languages of df. The driver collects one short row per seen (language, trigram): 2^18 a language at most, commonly some thousands."""
    counted = materialize(count_trigrams(df, text, lang), "trigrams")
    langs = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    if not langs:
        return Model([], (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))
    number = (F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1).cast("int")
    table = counted.select(number.alias("k"), "gram", "n").toArrow()
    return Model(langs, tuple(table.column(i).to_numpy().astype(t) for i, t in enumerate((np.int64, np.int64, np.float64))))


def em(ll: np.ndarray, starts: np.ndarray, active: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood per document. ll: segments x languages; active: documents x languages. Holds ROWS segments, or one document, at a time."""
    ends = np.r_[starts[1:], len(ll)]
    if len(ll) > ROWS and len(starts) > 1:
        share, total = np.empty(active.shape), np.empty(len(starts))
        d = 0
        while d < len(starts):
            e = max(d + 1, int(np.searchsorted(ends, starts[d] + ROWS, side="right")))
            share[d:e], total[d:e] = em(ll[starts[d] : ends[e - 1]], starts[d:e] - starts[d], active[d:e], rounds)
            d = e
        return share, total
    if len(starts) == 1:
        return _em_one(ll, active, rounds)
    sizes = ends - starts
    doc = np.repeat(np.arange(len(starts)), sizes)
    like, top = _relative(ll, active[doc])
    share = active / active.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        mixed = like * share[doc]
        mixed /= mixed.sum(axis=1, keepdims=True)
        share = np.add.reduceat(mixed, starts, axis=0) / sizes[:, None]
    total = np.add.reduceat(np.log(np.maximum((like * share[doc]).sum(axis=1), 1e-300)) + top, starts)
    return share, total


def _relative(ll: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = np.where(active, ll, -np.inf).max(axis=1, keepdims=True)
    return np.where(active, np.exp((ll - top).astype(np.float64)), 0.0), top[:, 0].astype(np.float64)


def _em_one(ll: np.ndarray, active: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """em of one document of any length, block by block."""
    share = active[0] / active[0].sum()
    for last in range(rounds + 1):
        mass, total = np.zeros(len(share)), 0.0
        for a in range(0, len(ll), ROWS):
            like, top = _relative(ll[a : a + ROWS], active)
            mixed = like * share
            sums = mixed.sum(axis=1, keepdims=True)
            if last == rounds:
                total += float((np.log(np.maximum(sums[:, 0], 1e-300)) + top).sum())
            else:
                mass += (mixed / sums).sum(axis=0)
        if last < rounds:
            share = mass / len(ll)
    return share[None, :], np.array([total])


def _long_likelihoods(model: Model, text: memoryview, segment: int) -> tuple[np.ndarray, bool]:
    """Segment likelihoods of one text of any length, and whether it has a letter."""
    parts, rest, tail, letter = [], np.zeros(0, np.uint32), np.zeros(2, np.uint32), False

    def take(codes: np.ndarray) -> None:
        nonlocal tail, letter
        letters = codes > 0
        letter = letter or bool(letters.any())
        parts.append(model.likelihoods(grams(np.concatenate((tail, codes))), letters, np.arange(0, len(codes), segment)))
        tail = np.concatenate((tail, codes))[-2:]

    for codes in decoded(text):
        rest = np.concatenate((rest, codes))
        whole = len(rest) // segment * segment - segment  # the last whole segment waits, as what follows may belong to it
        if whole > 0:
            take(rest[:whole])
            rest = rest[whole:]
    if len(rest):
        many = max(1, (len(rest) + 2) // segment)
        letters = rest > 0
        letter = letter or bool(letters.any())
        parts.append(model.likelihoods(grams(np.concatenate((tail, rest))), letters, np.arange(many) * segment))
    return (np.concatenate(parts) if parts else np.zeros((1, len(model.langs)), np.float32)), letter


def mixtures(model: Model, texts: list[str | None] | pa.Array, segment: int = SEGMENT, penalty: float = 6.0, rounds: int = 12) -> list[tuple[str, float, dict[str, float]]]:
    """(language, its proportion, proportions of the chosen set) of each text.

    A text that is null or has no letter is `und` with score 0 and no proportions; so is every text if the model knows no language.
    """
    if not isinstance(texts, pa.Array):
        texts = pa.array([None if t is None else t.encode("utf-8", "replace") for t in texts], pa.binary())
    out: list[tuple[str, float, dict[str, float]]] = [(UND, 0.0, {})] * len(texts)
    if not model.langs:
        return out
    for a, b in text_blocks(texts):
        if b - a == 1:
            ll, letter = _long_likelihoods(model, text_bytes(texts, a), segment)
            keep, first = ([a], np.zeros(1, np.int64)) if letter else ([], None)
        else:
            ll, first, keep = _short_likelihoods(model, texts, a, b, segment)
        if keep:
            for i, found in zip(keep, _choose(model, ll, first, penalty, rounds)):
                out[i] = found
    return out


def _short_likelihoods(model: Model, texts: pa.Array, a: int, b: int, segment: int) -> tuple[np.ndarray | None, np.ndarray | None, list[int]]:
    """Segment likelihoods of the texts a to b that have a letter, where each text's start, and these texts."""
    codes = [letter_codes(str(text_bytes(texts, i), "utf-8", "replace")) for i in range(a, b)]
    keep = [i for i in range(a, b) if codes[i - a].any()]
    if not keep:
        return None, None, []
    gap = np.zeros(2, np.uint32)
    joined = np.concatenate([x for i in keep for x in (gap, codes[i - a])])
    lengths = np.array([len(codes[i - a]) + 2 for i in keep])
    doc_at = np.r_[0, np.cumsum(lengths)[:-1]]
    n_seg = np.maximum(1, lengths // segment)
    first = np.r_[0, np.cumsum(n_seg)[:-1]]
    doc_of = np.repeat(np.arange(len(keep)), n_seg)
    # The two codes of the gap in front of a text are context: they are no letters and belong to the segment before.
    seg_at = doc_at[doc_of] + (np.arange(n_seg.sum()) - first[doc_of]) * segment
    letters = np.concatenate((joined[2:] > 0, np.zeros(2, bool)))
    return model.likelihoods(np.concatenate((grams(joined), np.zeros(2, np.int32))), letters, seg_at), first, keep


def _choose(model: Model, ll: np.ndarray, first: np.ndarray, penalty: float, rounds: int) -> list[tuple[str, float, dict[str, float]]]:
    """EM with all languages, then backward elimination: a document's weakest language goes while the penalised likelihood does not fall."""
    n_docs, n_langs = len(first), len(model.langs)
    n_seg = np.diff(np.r_[first, len(ll)])
    doc_of = np.repeat(np.arange(n_docs), n_seg)
    active = np.ones((n_docs, n_langs), bool)
    share, total = em(ll, first, active, rounds)
    trying = np.ones(n_docs, bool)
    for _ in range(n_langs - 1):
        weakest = np.where(active, share, np.inf).argmin(axis=1)
        fewer = active.copy()
        fewer[np.arange(n_docs), weakest] = False
        at = np.flatnonzero(trying & (active.sum(axis=1) > 1))
        if not len(at):
            break
        rows = ll if len(at) == n_docs else ll[np.isin(doc_of, at)]
        sub = np.r_[0, np.cumsum(n_seg[at])[:-1]]
        s, t = em(rows, sub, fewer[at], rounds)
        better = t + penalty >= total[at]
        won = at[better]
        active[won], share[won], total[won] = fewer[won], s[better], t[better]
        trying[at[~better]] = False
    best = share.argmax(axis=1)
    return [(model.langs[k], float(min(1.0, share[d, k])), {model.langs[j]: float(share[d, j]) for j in np.flatnonzero(active[d])}) for d, k in enumerate(best)]


def identify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with `lang_pred`, `score` (the language's proportion, 0 to 1) and `languages` (name -> proportion).

    Only the text is read, and all of it. Null texts and texts without a letter are `und`, score 0, with no languages. Rows are
    independent and none is dropped; an empty df gives an empty result; clashing columns are replaced.
    """
    added = ("lang_pred", "score", "languages")
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in added]
    own = fresh(df.select(F.col(text).alias("__text"), *names), *added)
    kinds = own.select(*names).schema.fields
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kinds] + ["lang_pred string, score double, languages map<string,double>"])
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = mixtures(sent.value, batch.column(0).cast(pa.binary()))
            more = [
                pa.array([x[0] for x in found], pa.string()),
                pa.array([x[1] for x in found], pa.float64()),
                pa.array([list(x[2].items()) for x in found], pa.map_(pa.string(), pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *more], names=[*names, *added])

    return own.mapInArrow(run, schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(id_crc("doc_id"), F.lit(4)) == 2
    model = train(docs.where(~held_out))
    found = identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
