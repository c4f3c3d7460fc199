"""SimHash near-duplicates: a Gray-order hierarchical index over 64-bit fingerprints.

Fingerprints sorted by Gray rank share long bit patterns with their neighbours. An index node keeps the bits that all
its fingerprints share (mask and pattern); two nodes whose shared bits already differ in more than `max_diff` places are
pruned as a whole. Differences accumulate downwards, as the masks widen, until leaves are compared bit by bit.

The uppermost nodes are spread over the cluster: max_diff + 1 disjoint masks cut the 64 bits, and two fingerprints that
differ in at most max_diff bits agree on at least one of them, so each link lies below a node with a shared pattern.
A node with too many fingerprints is cut again by other masks (the same argument) or into ranges of Gray ranks. Each range is summed up by its mask and
pattern, the same tree is built over the ranges, and only pairs of ranges that it doesn't prune are sent to a task together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import load, materialize
from ledgerlens.llm.components import connected_components

#: Fingerprints below one node that one task solves; above it the node is cut.
LEAF = 1024
#: Nodes above this are cut by further masks, those between LEAF and this into ranges of Gray ranks.
NODE = 65_536
#: Most ranges of one node.
RANGES = 128


def fingerprint(text: bytes, k: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the k-word shingles of a text, A-Z lowered, repeats counted; no word gives 0."""
    words = text.lower().split()
    n = len(words) - k + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, seed)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[: n - 1] + 1).tolist()]
    ends = [*gaps[k - 1 :].tolist(), len(joined)]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        hashes = np.fromiter((digest(joined[i:j], seed) for i, j in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", k: int = 3) -> DataFrame:
    """Columns of df but the text, and `fp` (the fingerprint's 64 bits as a long)."""
    keep = [c for c in df.columns if c not in (text, "fp")]
    schema = df.select(*keep, F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", k) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fps)], names=[*keep, "fp"])

    return df.select(*keep, text).mapInArrow(run, schema)


def gray_rank(fp: Column) -> Column:
    """Position of fp in the reflected Gray code (unsigned bits in a long)."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def masks(level: int, parts: int) -> list[int]:
    """Disjoint masks of the 64 bits: runs of bits, then strides of bits, then strides of longer steps."""
    groups = [[] for _ in range(parts)]
    for bit in range(64):
        groups[bit * parts // 64 if level == 0 else (bit // parts ** (level - 1)) % parts].append(bit)
    out = [sum(1 << b for b in g) for g in groups]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _nodes(df: DataFrame, level: int, parts: int) -> DataFrame:
    """Each fingerprint below its node for each mask of a level; node is a hash, as merged nodes only add comparisons."""
    cuts = F.array(*[F.xxhash64("node", F.lit(level), F.lit(r), F.col("fp").bitwiseAND(F.lit(m))) for r, m in enumerate(masks(level, parts))])
    return df.select("fp", F.explode(cuts).alias("node"))


def _close(left: np.ndarray, right: np.ndarray, max_diff: int) -> np.ndarray:
    return np.bitwise_count(left ^ right) <= max_diff


def tree(pattern: np.ndarray, mask: np.ndarray, fan: int = 16) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of nodes (pattern, mask of shared bits) over leaves in Gray order, leaves first; a node holds the bits that its children share."""
    levels = [(pattern & mask, mask)]
    while len(levels[-1][0]) > fan:
        p, m = levels[-1]
        at = np.arange(0, len(p), fan)
        both = np.bitwise_and.reduceat(p, at)
        shared = np.bitwise_and.reduceat(m, at) & ~(both ^ np.bitwise_or.reduceat(p, at))
        levels.append((both & shared, shared))
    return levels


def descend(levels: list[tuple[np.ndarray, np.ndarray]], max_diff: int = 3, fan: int = 16, seen: list[list[int]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf pairs (i <= j) whose shared bits differ in at most max_diff places. A pair of nodes that differs in more is pruned with all below it.

    seen, if given, counts per level, leaves first, the node pairs looked at and those kept.
    """
    spread = np.arange(fan)

    def down(i: np.ndarray, j: np.ndarray, depth: int):
        pattern, mask = levels[depth]
        keep = np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j]) <= max_diff
        if seen is not None:
            seen[depth][0] += len(i)
            seen[depth][1] += int(keep.sum())
        i, j = i[keep], j[keep]
        if not depth:
            yield i, j
            return
        size = len(levels[depth - 1][0])
        for s in range(0, len(i), 4096):
            a = np.repeat((i[s : s + 4096, None] * fan + spread)[:, :, None], fan, axis=2).ravel()
            b = np.repeat((j[s : s + 4096, None] * fan + spread)[:, None, :], fan, axis=1).ravel()
            keep = (a < size) & (b < size) & (a <= b)
            yield from down(a[keep], b[keep], depth - 1)

    if seen is not None:
        seen[:] = [[0, 0] for _ in levels]
    if len(levels[0][0]):
        yield from down(*np.triu_indices(len(levels[-1][0])), len(levels) - 1)


def close_pairs(f: np.ndarray, max_diff: int = 3, fan: int = 16, seen: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of f (uint64 in Gray order) within max_diff bits, by descending a tree of shared bit patterns."""
    for i, j in descend(tree(f, np.full(len(f), (1 << 64) - 1, np.uint64), fan), max_diff, fan, seen):
        yield i[i < j], j[i < j]


def forest(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of 0 to n - 1 through the pairs (and through earlier labels)."""
    label = np.arange(n) if label is None else label
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        low, high = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
        np.minimum.at(label, high, low)
        while True:
            hop = label[label]
            if (hop == label).all():
                break
            label = hop


def _links(max_diff: int, small: int = 24):
    """Solve nodes that arrive sorted by (node, i, j, Gray rank); emit a star per connected set below each node."""

    def solve(fps: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(fps)
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sizes = np.diff(np.r_[starts, n])
        label, left, right = np.arange(n), [], []
        tiny = np.repeat(sizes <= small, sizes)
        for lag in range(1, min(small, int(sizes.max(initial=0)))):
            at = np.flatnonzero(tiny[lag:] & (cell[lag:] == cell[:-lag]) & _close(fps[lag:], fps[:-lag], max_diff))
            left.append(at)
            right.append(at + lag)
        if left:
            label = forest(n, np.concatenate(left), np.concatenate(right), label)
        for s, m in zip(starts[sizes > small], sizes[sizes > small]):
            own = np.arange(m)
            for i, j in close_pairs(fps[s : s + m], max_diff):
                own = forest(m, i, j, own)
            label[s : s + m] = own + s
        off = np.flatnonzero(label != np.arange(n))
        return fps[label[off]], fps[off]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(fps, cell):
            a, b = solve(fps, cell)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column(0).to_numpy()
            fps = batch.column(1).to_numpy().view(np.uint64)
            if held:
                cell, fps = np.concatenate((held[0][0], cell)), np.concatenate((held[0][1], fps))
            change = np.flatnonzero(cell[1:] != cell[:-1])
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:
                yield flush(fps[:cut], cell[:cut])
            held = [(cell[cut:].copy(), fps[cut:].copy())]
        if held:
            yield flush(held[0][1], held[0][0])

    return run


def _range_pairs(large: DataFrame, max_diff: int, leaf: int) -> DataFrame:
    """(fp, node) below pairs of Gray ranges of large nodes (fp, node, n): only pairs that the tree over the ranges doesn't prune."""
    rank = gray_rank(F.col("fp")).bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order as a long
    wanted = F.least(F.lit(RANGES), F.ceil(F.max("n") * 2 / F.lit(leaf))).cast("int")
    cuts = F.percentile_approx("rank", [(i + 1) / RANGES for i in range(RANGES - 1)], 1_000)
    rows = large.withColumn("rank", rank)
    bounds = materialize(rows.groupBy("node").agg(cuts.alias("cuts"), wanted.alias("wanted")), "bounds")
    place = F.size(F.filter("cuts", lambda c: c <= F.col("rank"))) * F.col("wanted") / F.lit(RANGES)
    sliced = materialize(rows.join(bounds, "node").select("fp", "node", F.floor(place).cast("int").alias("slice")), "ranges")
    summary = sliced.groupBy("node", "slice").agg(F.bit_and("fp").alias("low"), F.bit_or("fp").alias("high"))

    def prune(table: pa.Table) -> pa.Table:
        table = table.sort_by("slice")
        low, high = (table.column(c).to_numpy().view(np.uint64) for c in ("low", "high"))
        found = [np.stack(x) for x in descend(tree(low, ~(low ^ high)), max_diff)]
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        apart = pairs[0] != pairs[1]
        paired = np.isin(pairs[0], pairs[:, apart])  # a range in any pair with another needs no task of its own
        pairs = pairs[:, apart | ~paired]
        slices = table.column("slice").to_numpy()
        node = np.full(pairs.shape[1], table.column("node")[0].as_py(), np.int64)
        return pa.table({"node": node, "one": slices[pairs[0]].astype(np.int32), "two": slices[pairs[1]].astype(np.int32)})

    pairs = summary.groupBy("node").applyInArrow(prune, "node long, one int, two int")
    ends = pairs.withColumn("slice", F.explode(F.array_distinct(F.array("one", "two"))))
    return sliced.join(ends, ["node", "slice"]).select("fp", F.xxhash64("node", "one", "two").alias("node"))


def link_fingerprints(fps: DataFrame, max_diff: int = 3, leaf: int = LEAF, node: int = NODE) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that connect exactly what differs by at most max_diff bits.

    Of the links below one node a spanning forest is kept; no connection between different fingerprints is lost.
    """
    parts = max_diff + 1
    now = fps.select("fp", F.lit(0).cast("long").alias("node"))
    solved = None
    for level in range(3):
        now = _nodes(now, level, parts)
        if level:
            now = now.distinct()
        large = materialize(now.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > leaf), "nodes")
        if large.isEmpty():
            cells, now = now.select("fp", "node"), None
        else:
            marked = now.join(large, "node", "left")
            cut = F.col("n") > leaf if level == 2 else F.col("n").between(leaf + 1, node)
            cells = marked.where("n IS NULL").select("fp", "node").unionByName(_range_pairs(marked.where(cut), max_diff, leaf))
            rest = marked.where(F.col("n") > node) if level < 2 else None
            now = rest.select("fp", "node") if rest is not None and not large.where(F.col("n") > node).isEmpty() else None
        solved = cells if solved is None else solved.unionByName(cells)
        if now is None:
            break
    ordered = solved.select("node", "fp").repartition("node").sortWithinPartitions("node", gray_rank(F.col("fp")))
    return ordered.mapInArrow(_links(max_diff), "a long, b long")


def groups(rows: DataFrame, ids: str, max_diff: int = 3) -> DataFrame:
    """rows (ids, fp, ...) with `component` (smallest id of the linked set) and `root` (a fingerprint that names the set)."""
    distinct = materialize(rows.groupBy("fp").agg(F.min(ids).alias("low")), "distinct")
    links = materialize(link_fingerprints(distinct.select("fp"), max_diff), "links")
    roots = connected_components(links)
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "roots")
    lows = named.groupBy("root").agg(F.min("low").alias("component"))
    names = materialize(named.join(lows, "root").select(F.col("fp").alias("__fp"), "component", "root"), "names")
    return rows.join(names, rows["fp"] == names["__fp"]).drop("__fp")


def near_duplicates(df: DataFrame, ids: str = "doc_id", text: str = "text", k: int = 3, max_diff: int = 3) -> DataFrame:
    """(ids, fp, component) for every row of df: component is the smallest id reachable over links of max_diff bits.

    Null and empty texts have fingerprint zero and link like any other. A null id takes part but is no component name:
    a component of null ids only is null. Repeated rows stay repeated. An empty df gives an empty result; other columns are ignored.
    """
    rows = materialize(fingerprints(df.select(F.col(ids), F.col(text).alias("text")), "text", k), "fp")
    return groups(rows, ids, max_diff).select(ids, "fp", "component")


def keep_one(df: DataFrame, ids: str = "doc_id", text: str = "text", k: int = 3, max_diff: int = 3) -> DataFrame:
    """df with one row of each linked set: the one of the smallest id (null ids last, then the smallest hash of the row).

    Null and empty texts are one set with all others of fingerprint zero. Rows equal in every column become one before anything is
    joined, with partial aggregates, so that no task gets all copies. Columns keep their names and values; an empty df gives an empty result.
    """
    names = df.columns
    keyed = df.withColumn("__h", F.xxhash64(*names)).withColumn("__g", F.xxhash64(F.lit(1), *names))
    rows = materialize(fingerprints(keyed.select(F.col(ids).alias("__id"), "__h", "__g", F.col(text).alias("__text")), "__text", k), "fp")
    first = F.min(F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("i"), F.col("__h").alias("h"), F.col("__g").alias("g")))
    keep = groups(rows, "__id", max_diff).groupBy("root").agg(first.alias("x")).select(F.col("x.h").alias("__h"), F.col("x.g").alias("__g"))
    one = keyed.dropDuplicates(["__h", "__g"])
    return one.join(materialize(keep, "keep"), ["__h", "__g"], "left_semi").select(*names)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
