"""Exact top-k inner-product search: a Voronoi kNN join.

1. Queries and data are assigned to their nearest pivots (Voronoi cells); pivots are a bounded, hash-chosen set of rows that grows with the data.
2. Each cell has a summary: number of vectors, largest distance to the pivot, largest norm and the k + 1 smallest distances. From the summaries
   alone each query cell gets a score that its k best partners reach at least.
3. Query cells that lie near each other form groups of at most QUERY_BLOCK queries (a cell with more is cut into blocks). A data vector goes only to groups
   with a cell whose bound (pivot score + cell radius x norm) reaches the cell's score.
4. Each (group, slice of what was dealt to it) is solved locally: its queries are held, its data streams by in batches. A last merge keeps the k best per query.

Bounds only save replication: every pair that could be among the k best meets in exactly one task. On vectors without clusters no bound holds anything back,
and this is a blocked search of all pairs; `replication` tells how many groups a vector reaches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import load, materialize, partitions

#: Pivots are at most this many, whatever the data: they and the cell summaries (k + 1 distances a cell) are the only things sent to every task.
MAX_PIVOTS = 1_024
#: Queries that one task holds, and the data vectors that stream by it.
QUERY_BLOCK = 8_192
DATA_SLICE = 524_288
_LONG = (1 << 63) - 1


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def integer_vectors(df: DataFrame, ids: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, v): each component floor(scale * x), as a double (exact at any size). Null vectors, null or non-finite components and null ids take no part."""
    parts = F.col(vector)
    finite = parts.isNotNull() & F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def whole(x):
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    return df.where(F.col(ids).isNotNull()).where(finite).select(F.col(ids).alias("id"), F.transform(parts, whole).alias("v"))


def _assign(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(rid, id, v, cell, dist, norm): row number, and the nearest pivot of each vector."""
    dim = pivots.shape[1]
    half = (pivots**2).sum(axis=1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(2), dim)
            cell = (v @ pivots.T - half).argmax(axis=1)
            dist = np.sqrt(((v - pivots[cell]) ** 2).sum(axis=1))
            more = [pa.array(cell.astype(np.int32)), pa.array(dist), pa.array(np.sqrt((v**2).sum(axis=1)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=["rid", "id", "v", "cell", "dist", "norm"])

    rows = df.select(F.monotonically_increasing_id().alias("rid"), "id", "v")
    return rows.mapInArrow(run, "rid long, id long, v array<double>, cell int, dist double, norm double")


def _summary(df: DataFrame, nearest: int = 0) -> dict[int, tuple[int, float, float, list[float]]]:
    """Per cell: vectors, largest distance, largest norm and the `nearest` smallest distances. One short row per cell and distance reaches the driver."""
    rows = df.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("r"), F.max("norm").alias("m")).collect()
    near: dict[int, list[float]] = {r["cell"]: [] for r in rows}
    if nearest:
        first = Window.partitionBy("cell").orderBy("dist")
        for r in df.select("cell", "dist", F.row_number().over(first).alias("at")).where(F.col("at") <= nearest).collect():
            near[r["cell"]].append(r["dist"])
    return {r["cell"]: (r["n"], r["r"], r["m"], sorted(near[r["cell"]])) for r in rows}


def reached_scores(pivots: np.ndarray, queries: dict, data: dict, k: int) -> dict[int, float]:
    """For each query cell a score that at least k + 1 data vectors reach with every query of the cell (one may be the query)."""
    gram = pivots @ pivots.T
    norms = np.sqrt(np.maximum(np.diag(gram), 0.0))
    far = np.array([(d, f, m) for d, (n, r, m, near) in data.items() for f in (near or [r] * min(n, k + 1))])
    out = {}
    for c, (_, radius, _, _) in queries.items():
        # q = p + e, x = s + f:  q.x >= p.s - |p||f| - |e||x|
        lows = gram[c, far[:, 0].astype(int)] - norms[c] * far[:, 1] - radius * far[:, 2]
        out[c] = float(np.partition(lows, len(lows) - k - 1)[len(lows) - k - 1]) if len(lows) > k else -math.inf
    return out


def group_cells(pivots: np.ndarray, sizes: dict[int, int], block: int) -> list[tuple[list[int], int]]:
    """(cells, blocks) per group: near cells together up to `block` queries; a larger cell is a group of its own, cut into blocks."""
    out = [([c], math.ceil(n / block)) for c, n in sorted(sizes.items()) if n > block]
    left = [c for c, n in sorted(sizes.items()) if n <= block]
    while left:
        own = [left.pop(0)]
        room = block - sizes[own[0]]
        for j in np.argsort(((pivots[left] - pivots[own[0]]) ** 2).sum(axis=1), kind="stable") if left else ():
            if sizes[left[j]] > room:
                break
            own.append(left[j])
            room -= sizes[left[j]]
        left = [c for c in left if c not in own]
        out.append((own, 1))
    return out


def _spread(rid: np.ndarray, n: np.ndarray | int, salt: int) -> np.ndarray:
    """Number below n of each row, by a hash of the row and not of its id, so that a repeated id does not meet in one task."""
    h = (rid.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(33)) % np.asarray(n, np.uint64)).astype(np.int32)


class _Best:
    """The k best of each query of a block, while data streams by."""

    def __init__(self, q: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.ids, self.k = q, ids, k
        self.norm = float(np.sqrt((q**2).sum(axis=1)).max(initial=0.0))
        self.least = np.full(len(q), -np.inf)
        self.rows, self.found, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, x: np.ndarray, ids: np.ndarray) -> None:
        exact = self.norm * float(np.sqrt((x**2).sum(axis=1)).max(initial=0.0)) < 2.0**53
        for a in range(0, len(self.q), 512):
            q = self.q[a : a + 512]
            if exact:
                scores = q @ x.T
            else:  # beyond what a double holds: whole numbers of any size, cut at the limits of a long
                big = np.array([[int(y) for y in row] for row in q], object) @ np.array([[int(y) for y in row] for row in x], object).T
                scores = np.clip(big, -_LONG, _LONG)
            own = self.ids[a : a + 512, None] == ids[None, :]
            low = self.least[a : a + 512]
            keep = (scores >= low[:, None]) & ~own
            if exact and np.isinf(low).any() and scores.shape[1] > self.k + 1:
                # The k + 1 best of the batch (one may be the query itself) are enough.
                cut = np.partition(scores, scores.shape[1] - self.k - 1, axis=1)[:, scores.shape[1] - self.k - 1]
                keep &= (scores >= cut[:, None]) | (own.sum(axis=1) > 1)[:, None]
            i, j = np.nonzero(keep)
            if len(i):
                self._merge(i + a, ids[j], scores[i, j])

    def _merge(self, rows, ids, scores) -> None:
        touched = np.zeros(len(self.q), bool)
        touched[rows] = True
        old = touched[self.rows]
        r, f, s = (np.concatenate(x) for x in ((self.rows[old], rows), (self.found[old], ids), (self.scores[old], scores)))
        order = np.lexsort((f, -s, r))
        r, f, s = r[order], f[order], s[order]
        start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        rank = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
        keep = rank < self.k
        last = rank == self.k - 1
        self.least[r[last]] = np.nextafter(s[last].astype(np.float64), -np.inf)  # a whole number beyond 2^53 may have been rounded up
        self.rows, self.found, self.scores = (np.concatenate((x[~old], y[keep])) for x, y in ((self.rows, r), (self.found, f), (self.scores, s)))


def top_k(queries: DataFrame, data: DataFrame, k: int = 20, dim: int | None = None, seed: int = 5, report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query with rows of data of another id.

    queries and data have (id long, v array<double> of whole numbers); other columns are ignored. Ties go to the smaller id; fewer candidates
    give fewer rows. Repeated ids are candidates of their own, and each query row is answered on its own. Vectors of another length than `dim` (default: the
    commonest in data), null vectors and null ids take no part. Scores are exact at any size; beyond a long they stop at its limits. Empty inputs give an empty result.
    report, if given, gets the numbers of pivots, groups and slices and the replication of a data vector.
    """
    spark = data.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    data, queries = (x.select("id", "v").where("id IS NOT NULL AND v IS NOT NULL") for x in (data, queries))
    if dim is None:
        sizes = data.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = sizes["d"] if sizes else 0
    if not dim:
        return none
    data, queries = data.where(F.size("v") == dim), queries.where(F.size("v") == dim)
    # Pivots: rows with the smallest hashes, about half the root of the number of vectors.
    n_data = data.count()
    n_pivots = int(min(MAX_PIVOTS, max(4, math.sqrt(n_data) / 2)))
    picked = data.select("v").orderBy(F.xxhash64(F.lit(seed), F.col("id")), "id").limit(n_pivots).collect()
    if not picked:
        return none
    pivots = np.unique(np.array([r["v"] for r in picked], np.float64), axis=0)
    held = materialize(_assign(data, pivots), "knn-data")
    asked = materialize(_assign(queries, pivots), "knn-queries")
    q_cells, d_cells = _summary(asked), _summary(held, k + 1)
    if not q_cells:
        return none
    reached = reached_scores(pivots, q_cells, d_cells, k)
    teams = group_cells(pivots, {c: x[0] for c, x in q_cells.items()}, QUERY_BLOCK)
    cells = np.array([c for own, _ in teams for c in own])
    team_at = np.r_[0, np.cumsum([len(own) for own, _ in teams])[:-1]]  # where a group's cells start
    blocks = np.array([b for _, b in teams])
    first = np.r_[0, np.cumsum(blocks)[:-1]]  # first block of a group
    radius, least, centres = np.array([q_cells[c][1] for c in cells]), np.array([reached[c] for c in cells]), pivots[cells]
    centre_norm = np.sqrt((centres**2).sum(axis=1))
    team_of = np.zeros(len(pivots), np.int64)
    team_of[cells] = np.repeat(np.arange(len(teams)), [len(own) for own, _ in teams])

    def wanted(v: np.ndarray) -> np.ndarray:
        """Vectors x groups: whether one of the group's queries may want the vector. The slack is relative to what was added up."""
        norm = np.sqrt((v**2).sum(axis=1))[:, None]
        size = norm * (centre_norm + radius)
        reach = v @ centres.T + radius * norm + 1e-9 * size >= least - 1e-9 * np.where(np.isfinite(least), np.abs(least), 0.0)
        return np.logical_or.reduceat(reach, team_at, axis=1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(teams), np.int64)
        for batch in batches:
            if batch.num_rows:
                total += wanted(_matrix(batch.column(0), dim)).sum(axis=0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["team", "n"])

    dealt_to = np.zeros(len(teams), np.int64)
    for r in held.select("v").mapInArrow(count, "team int, n long").groupBy("team").agg(F.sum("n").alias("n")).collect():
        dealt_to[r["team"]] = r["n"]
    team_queries = np.array([sum(q_cells[c][0] for c in own) for own, _ in teams], np.float64)
    work = dealt_to * team_queries
    n_parts = partitions(spark)
    # Slices: what a task may stream by, and enough for every core to have some; small ones are not worth a copy of the queries.
    fair = np.ceil(2 * n_parts * work / max(work.sum(), 1.0) / blocks)
    slices = np.maximum(1, np.maximum(np.ceil(dealt_to / DATA_SLICE), np.minimum(fair, np.ceil(dealt_to / 4_096)))).astype(np.int64)
    if report is not None:
        report.update(pivots=len(pivots), groups=int(blocks.sum()), slices=int((slices * blocks).sum()), replication=float((dealt_to * blocks).sum() / max(n_data, 1)))
    names = ["block", "slice", "kind", "rid", "id", "v"]
    kinds = "block int, slice int, kind int, rid long, id long, v array<double>"

    def emit(batch: pa.RecordBatch, row: np.ndarray, block: np.ndarray, part: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(row), 8_192):
            own = batch.take(pa.array(row[a : a + 8_192]))
            head = [pa.array(x.astype(np.int32)) for x in (block[a : a + 8_192], part[a : a + 8_192], np.full(len(own), kind))]
            yield pa.RecordBatch.from_arrays([*head, *own.columns[:3]], names=names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, team = np.nonzero(wanted(_matrix(batch.column(2), dim)))
            part = _spread(batch.column(0).to_numpy()[row], slices[team], 1)
            for b in range(int(blocks.max())):  # every block of a group gets the vector
                more = blocks[team] > b
                yield from emit(batch, row[more], first[team[more]] + b, part[more], 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            team = team_of[batch.column(3).to_numpy()]
            block = first[team] + _spread(batch.column(0).to_numpy(), blocks[team], 2)
            for part in range(int(slices.max())):
                row = np.flatnonzero(slices[team] > part)
                yield from emit(batch, row, block[row], np.full(len(row), part), 0)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asking, best = None, [], None

        def close() -> Iterator[pa.RecordBatch]:
            if best is not None and len(best.rows):
                cols = [best.rid[best.rows], best.ids[best.rows], best.found, np.array([int(x) for x in best.scores], np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["rid", "query_id", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            block, part, kind = (batch.column(i).to_numpy() for i in range(3))
            same = (block[1:] == block[:-1]) & (part[1:] == part[:-1]) & (kind[1:] == kind[:-1])
            cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:]):
                if key != (block[a], part[a]):
                    yield from close()
                    key, asking, best = (block[a], part[a]), [], None
                rid, ids, v = (batch.column(i).slice(a, b - a) for i in range(3, 6))
                if kind[a] == 0:
                    asking.append((rid.to_numpy(), ids.to_numpy(), _matrix(v, dim)))
                    continue
                if best is None and asking:
                    best = _Best(np.concatenate([x[2] for x in asking]), np.concatenate([x[1] for x in asking]), k)
                    best.rid = np.concatenate([x[0] for x in asking])
                if best is not None:
                    best.add(_matrix(v, dim), ids.to_numpy())
        yield from close()

    rows = held.select("rid", "id", "v").mapInArrow(deal, kinds).unionByName(asked.select("rid", "id", "v", "cell").mapInArrow(ask, kinds))
    together = rows.repartition(max(n_parts, min(int((slices * blocks).sum()), 8 * n_parts)), "block", "slice").sortWithinPartitions("block", "slice", "kind")
    near = together.mapInArrow(solve, "rid long, query_id long, vec_id long, score long")
    order = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = materialize(integer_vectors(load(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors.where(F.col("id") % 20 == 0), vectors)


OP5_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
  FROM e q JOIN e x ON q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
