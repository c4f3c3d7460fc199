"""Benchmark decontamination: one Aho-Corasick automaton over item windows, one scan of each text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import fresh, load, materialize

#: Most benchmark characters in one automaton (about 60 bytes of a worker's memory each); a larger benchmark is scanned for in blocks of whole items up to this size.
BLOCK_CHARS = 4_000_000
#: Most words in one automaton: each different one is a code point of its own, of which there are 1,112,063 without surrogates and 0.
BLOCK_WORDS = 1_000_000
#: ASCII bytes that are no letter and no digit become a space; A-Z become a-z; all other bytes stay.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _letter(k: int) -> str:
    """k-th code point above 0 that is no surrogate; 0 stands for words of no item."""
    return chr(k if k < 0xD800 else k + 0x800)


class Windows:
    """The automaton of all windows of the items. Each item word is one letter, so a text is scanned word by word and offsets are word numbers."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int):
        self.letters: dict[bytes, str] = {}
        self.width = width
        #: A word of every window, its longest: only words near one of them can be part of a window and are run through the automaton.
        self.anchors: set[bytes] = set()
        found: dict[str, set] = {}
        for name, text in items:
            parts = words(text)
            own = "".join([self.letters.setdefault(w, _letter(len(self.letters) + 1)) for w in parts])
            for i in range(max(1, len(own) - width + 1) if own else 0):
                found.setdefault(own[i : i + width], set()).add(name)
                if self.anchors.isdisjoint(window := parts[i : i + width]):
                    self.anchors.add(max(window, key=len))
        self.automaton = ahocorasick.Automaton()
        for key, names in found.items():
            self.automaton.add_word(key, (len(key), tuple(x for x in names if x is not None)))
        if found:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit word spans [start, end), item names."""
        parts = words(text)
        anchors, reach = self.anchors, self.width
        at = [i for i, w in enumerate(parts) if w in anchors]
        merged: list[tuple[int, int]] = []
        names: set[str] = set()
        seen: set[int] = set()
        k = 0
        while k < len(at):
            # A stretch of words around anchors that are near each other: every window in the text lies inside one.
            start, k = max(0, at[k] - reach + 1), k + 1
            while k < len(at) and at[k] - at[k - 1] < 2 * reach - 1:
                k += 1
            stretch = parts[start : at[k - 1] + reach]
            # Ends come in order; a longer window may reach back over spans found before.
            for last, (n, own) in self.automaton.iter("".join(map(self.letters.get, stretch, repeat("\0")))):
                a, b = start + last + 1 - n, start + last + 1
                while merged and merged[-1][1] >= a:
                    a = min(a, merged.pop()[0])
                merged.append((a, b))
                if id(own) not in seen:
                    seen.add(id(own))
                    names.update(own)
        return len(parts), merged, names


def offsets(text: str | bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character spans of the original text for word spans."""
    if not spans:
        return []
    raw = text.encode() if isinstance(text, str) else text
    space = np.frombuffer(b" " + raw.translate(_TABLE) + b" ", np.uint8) == 32
    starts, ends = np.flatnonzero(space[:-2] & ~space[1:-1]), np.flatnonzero(~space[1:-1] & space[2:]) + 1
    chars = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]  # characters that begin before each byte
    return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in spans]


def blocks(items: Iterator[tuple[str | None, bytes]], width: int, chars: int = BLOCK_CHARS, most: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items in blocks of at most `chars` bytes and `most` words. A longer item goes in pieces that overlap by width - 1 words, so no window is lost."""
    own, size, count = [], 0, 0
    for name, text in items:
        parts = words(text)
        pieces = [(text, len(parts))]
        if len(text) > chars or len(parts) > most:
            room = max(width, min(most, chars * len(parts) // max(len(text), 1)))
            pieces = [(b" ".join(parts[a : a + room]), room) for a in range(0, max(1, len(parts) - width + 1), room - width + 1)]
        for piece, n in pieces:
            if own and (size + len(piece) > chars or count + n > most):
                yield own
                own, size, count = [], 0, 0
            own.append((name, piece))
            size, count = size + len(piece), count + n
    if own:
        yield own


_BUILT: dict[tuple, Windows] = {}

SCAN = "n_words long, spans array<struct<first:long,last:long,from:long,to:long>>, items array<string>"


def _scan_block(df: DataFrame, text: str, items: list[tuple[str | None, bytes]], width: int) -> DataFrame:
    """df with n_words, spans (merged hit word spans [first, last), and [from, to) in characters of the text) and items, by one automaton sent to every executor."""
    sent = df.sparkSession.sparkContext.broadcast(items)
    token = (hashlib.sha256(repr(items).encode()).hexdigest(), width)
    names = df.columns
    at = names.index(text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [SCAN])
    span = pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "last", "from", "to")]))

    def spans(text: bytes | None, found: list[tuple[int, int]]) -> list[dict]:
        return [{"first": a, "last": b, "from": c, "to": d} for (a, b), (c, d) in zip(found, offsets(text or b"", found))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _BUILT:
            _BUILT.clear()
            _BUILT[token] = Windows(sent.value, width)
        windows = _BUILT[token]
        for batch in batches:
            scans, found = [], []
            for t in batch.column(at).cast(pa.binary()):
                raw = t.as_py()
                scans.append(windows.scan(raw or b""))
                found.append(spans(raw, scans[-1][1]))
            more = [
                pa.array([n for n, _, _ in scans], pa.int64()),
                pa.array(found, span),
                pa.array([sorted(x) for _, _, x in scans], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, "n_words", "spans", "items"])

    return df.mapInArrow(run, schema)


def contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 10, block: int = BLOCK_CHARS, most: int = BLOCK_WORDS) -> DataFrame:
    """df with `n_words`, `spans` (hit spans: words first to before last, characters of the original text from to before to) and `items` (names with occurring windows).

    A window is `width` consecutive words of an item, or the whole of a shorter item with words. Null and empty texts have
    no words; a null item text has no window; a null item name marks words but is not listed; repeated items and rows count once
    and stay repeated, respectively. Clashing columns of df are replaced. An empty df or benchmark gives no hits.
    Up to `block` bytes and `most` words the benchmark is one automaton and the texts are scanned once; beyond that they are scanned once
    for each block of that size and the blocks' hits are united.
    """
    df = fresh(df, "n_words", "spans", "items")
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).where("text IS NOT NULL").distinct().sort("item", "text")
    pieces = blocks(((r["item"], r["text"].encode()) for r in items.toLocalIterator()), width, block, most)
    own, after = next(pieces, []), next(pieces, None)
    if after is None:
        return _scan_block(df, text, own, width)
    names = df.columns
    keyed = materialize(df.withColumn("__rid", F.monotonically_increasing_id()), "scan")
    hits = None
    while own:
        found = materialize(_scan_block(keyed.select("__rid", F.col(text).alias("__text")), "__text", own, width).drop("__text"), "hits")
        hits = found if hits is None else hits.unionByName(found)
        own, after = after, next(pieces, None)
    united = hits.groupBy("__rid").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    return keyed.join(united.withColumn("spans", _merge_spans("spans")), "__rid").select(*names, "n_words", "spans", "items")


def _merge_spans(spans: str):
    """Union of word spans: sorted, and joined where they touch."""
    return F.expr(
        f"""aggregate(array_sort({spans}), cast(array() AS array<struct<first:bigint,last:bigint,from:bigint,to:bigint>>), (done, s) ->
        CASE WHEN size(done) > 0 AND s.first <= element_at(done, -1).last
        THEN concat(slice(done, 1, size(done) - 1), array(named_struct('first', element_at(done, -1).first, 'last', greatest(element_at(done, -1).last, s.last),
            'from', element_at(done, -1).from, 'to', greatest(element_at(done, -1).to, s.to))))
        ELSE concat(done, array(s)) END)"""
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
), hits AS (SELECT dw.rid, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
spots AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
names AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY rid)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(s.n_hit, 0)::BIGINT AS n_hit, coalesce(m.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(s.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots s ON d.rid = s.rid LEFT JOIN names m ON d.rid = m.rid
"""
