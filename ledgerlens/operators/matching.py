"""Entity matching: set-overlap joins, trigram joins, tiers, scores, identity ladders."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import clean, trigrams, zip5
from ledgerlens.sources.shared import materialize


def overlap_join(left: DataFrame, right: DataFrame, threshold: float, left_id: str = "left_id", right_id: str = "right_id", tokens: str = "tokens") -> DataFrame:
    """(left_id, right_id, shared, score) of sets whose Jaccard similarity is at least the threshold (above 0).

    Equal sets are compared once. Prefix filter: with tokens in ascending order of frequency, two sets above the threshold share one of their first
    n - ceil(threshold * n) + 1 tokens. Only those rare tokens are joined, so common tokens make no candidate pairs; candidates are then
    compared in full. No result is lost.
    """
    keyed = lambda df, ids: df.where(F.size(tokens) > 0).select(F.col(ids), F.array_sort(tokens).alias("set")).withColumn("key", F.md5(F.concat_ws("\x1e", "set")))
    a, b = keyed(left, left_id), keyed(right, right_id)
    sets = lambda df: df.select("key", "set").dropDuplicates(["key"])
    one, two = sets(a), sets(b)
    freq = one.select(F.explode("set").alias("t")).unionByName(two.select(F.explode("set").alias("t"))).groupBy("t").agg(F.count("*").alias("f"))

    def rare(df: DataFrame) -> DataFrame:
        """(key, n, t): the rare tokens of each set and its size."""
        parts = df.select("key", F.explode("set").alias("t")).join(freq, "t").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("o"))
        n = F.size("o")
        return parts.select("key", n.alias("n"), F.explode(F.slice("o", F.lit(1), n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1)).alias("x")).select("key", "n", F.col("x.t").alias("t"))

    # Candidates travel as keys and sizes; sets are fetched once per candidate, ids once per match.
    near = rare(one).select("t", F.col("key").alias("ka"), F.col("n").alias("na")).join(rare(two).select("t", F.col("key").alias("kb"), F.col("n").alias("nb")), "t")
    near = near.where(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold) - F.lit(1e-9)).select("ka", "kb", "na", "nb").distinct()
    both = near.join(one.select(F.col("key").alias("ka"), F.col("set").alias("sa")), "ka").join(two.select(F.col("key").alias("kb"), F.col("set").alias("sb")), "kb")
    found = both.select("ka", "kb", F.size(F.array_intersect("sa", "sb")).alias("shared"), (F.col("na") + F.col("nb")).alias("n")).withColumn("score", F.col("shared") / (F.col("n") - F.col("shared")))
    found = found.where(F.col("score") >= threshold)
    out = found.join(a.select(left_id, F.col("key").alias("ka")), "ka").join(b.select(right_id, F.col("key").alias("kb")), "kb")
    return out.select(left_id, right_id, "shared", F.round("score", 4).alias("score"))


def trigram_pairs(df: DataFrame, ids: str, text: str, threshold: float, block: list[str] | None = None) -> DataFrame:
    """Unordered pairs of rows with trigram similarity at or above the threshold, within equal blocks if given.

    The block becomes part of each trigram, so that the exact prefix filter also spares the pairs of a crowded block. Null blocks match nothing.
    """
    grams = trigrams(F.col(text))
    rows = df
    if block:
        key = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in block])
        for c in block:
            rows = rows.where(F.col(c).isNotNull())
        rows = rows.withColumn("__block", key)
        grams = F.transform(grams, lambda g: F.concat_ws("\x1f", F.col("__block"), g))
    rows = rows.select(F.col(ids).alias("id"), grams.alias("tokens"))
    left, right = rows.withColumnRenamed("id", "left_id"), rows.withColumnRenamed("id", "right_id")
    return overlap_join(left, right, threshold).where("left_id < right_id").select("left_id", "right_id", "score")


def address_score(city_a: Column, state_a: Column, zip_a: Column, city_b: Column, state_b: Column, zip_b: Column) -> Column:
    """1.0 same zip, city and state, 0.7 same zip and state, 0.5 same city and state, 0.2 same state, else 0 (also without a state)."""
    same = lambda a, b: F.coalesce(F.lower(clean(a)) == F.lower(clean(b)), F.lit(False))
    zips = F.coalesce((zip5(zip_a) != "") & (zip5(zip_a) == zip5(zip_b)), F.lit(False))
    return F.when(~same(state_a, state_b), 0.0).when(zips & same(city_a, city_b), 1.0).when(zips, 0.7).when(same(city_a, city_b), 0.5).otherwise(0.2)


def tiered_match(left: DataFrame, right: DataFrame, tiers: list[tuple[str, list[str], float]], left_id: str, right_id: str, order: list, keep: int = 3) -> DataFrame:
    """First tier with a match wins per left row; of its matches the first `keep` in the order stay, with the tier's confidence.

    A tier is (name, equal columns, confidence); blank or null columns never match. The order is one of the right rows, so of each tier key only
    its first `keep` right rows are joined: a left row meets at most `keep` rows a tier, however crowded a key is.
    """
    union = None
    for rank, (name, columns, confidence) in enumerate(tiers):
        a, b = left, right
        for c in columns:
            a, b = a.where(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""), b.where(F.col(c).isNotNull())
        b = b.withColumn("__r", F.row_number().over(Window.partitionBy(*columns).orderBy(*order))).where(F.col("__r") <= keep).drop("__r")
        found = a.select(left_id, *columns).join(b.select(right_id, *dict.fromkeys([*columns, *[c for c in right.columns if c not in (right_id, *columns)]])), columns)
        found = found.select(left_id, right_id, *[c for c in right.columns if c not in (right_id, *[x for t in tiers for x in t[1]])], F.lit(rank).alias("__rank"), F.lit(name).alias("tier"), F.lit(confidence).alias("confidence"))
        union = found if union is None else union.unionByName(found)
    best = union.withColumn("__best", F.min("__rank").over(Window.partitionBy(left_id))).where("__rank = __best")
    best = best.dropDuplicates([left_id, right_id])
    n = F.row_number().over(Window.partitionBy(left_id).orderBy(*order))
    return best.withColumn("__n", n).where(F.col("__n") <= keep).drop("__n", "__rank", "__best")


def ratio(shared: Column, n: Column, factor: float = 1.0) -> Column:
    """factor * shared / n as SQL has it: NaN for two empty sets, null with a null set."""
    return F.when(n == 0, float("nan")).otherwise(factor * shared / F.greatest(n, F.lit(1)))


def top2_candidates(rows: DataFrame, ids: str, block: str, tokens: str, equal: list[str], score: Callable[[Column, Column, list[Column]], Column]) -> DataFrame:
    """(left_id, right_id, score): for each row the two best rows of its block with other ids, ties to the smaller id. Null ids and blocks match nothing.

    `score` gets the number of shared tokens, that of the tokens of either set (see `ratio`) and whether each of the `equal` columns agrees. It must grow with the
    ratio, and more agreement must never lower it. Rows of one block, set of tokens and `equal` columns are a class and have the same candidates but for themselves.
    Every subset of the columns may agree: a class's best partner whose agreement is exactly a subset S is one of the first three, by ratio then id, of the block's
    rows that agree on S, as what comes before it there scores no less (of the three one may be the row itself; where ids repeat, as many more are kept). Sets are
    compared once each and only where they share a token; of those without one the first three ids do.

    Stored tables hold repeats in a few bytes, so Spark takes them for small: sides that grow with the rows are merged, never broadcast through the driver.
    """
    base = rows.select(ids, F.col(block).alias("__b"), *[F.col(c).alias(f"__e{i}") for i, c in enumerate(equal)], F.array_sort(tokens).alias("__w"))
    base = base.where(F.col(ids).isNotNull() & F.col("__b").isNotNull()).withColumn("__s", F.coalesce(F.unhex(F.sha2(F.to_json("__w"), 256)), F.lit(b"")))
    base = materialize(base, "rows")
    keep = 2 + (base.groupBy(ids).count().agg(F.max("count")).first()[0] or 0)
    first = lambda df, keys, order: df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__k") <= keep).drop("__k")

    words = base.where("__w IS NOT NULL").select("__s", "__w").dropDuplicates(["__s"])
    each = words.select("__s", F.size("__w").alias("m"), F.explode("__w").alias("t"))
    near = each.alias("x").join(each.hint("merge").alias("y"), F.col("x.t") == F.col("y.t")).groupBy(F.col("x.__s").alias("__s"), F.col("y.__s").alias("z")).agg(F.count("*").cast("int").alias("shared"), F.first(F.col("x.m") + F.col("y.m")).alias("sum"))
    empty = words.where(F.size("__w") == 0).select("__s", F.col("__s").alias("z"), F.lit(0).alias("shared"), F.lit(0).alias("n"))
    near = materialize(near.select("__s", "z", "shared", (F.col("sum") - F.col("shared")).alias("n")).unionByName(empty), "near")
    near = near if near.count() < 50_000 else near.hint("merge")

    kinds = [f"__e{i}" for i in range(len(equal))]
    key = ["__b", *kinds, "__s"]
    members = materialize(first(base.select(*key, F.col(ids).alias("id")), key, ["id"]), "members")
    # One plan serves all subsets: a row goes once into the group g of each subset k of columns that it fills, with its values there.
    cells = [(k, [kinds[i] for i in range(len(kinds)) if k >> i & 1]) for k in range(1 << len(kinds))]
    filled = lambda own: functools.reduce(lambda x, c: x & F.col(c).isNotNull(), own, F.lit(True))
    groups = F.array(*[F.when(filled(own), F.struct(F.lit(k).alias("k"), F.to_json(F.array(F.lit(str(k)), *[F.col(c).cast("string") for c in ["__b", *own]])).alias("g"))) for k, own in cells])
    spread = lambda df: df.withColumn("x", F.explode(F.filter(groups, lambda x: x.isNotNull()))).select("*", "x.k", "x.g").drop("x")
    none = lambda c: F.col(c) == F.lit(b"")
    left = spread(members.select(*key).distinct()).select("g", "__s").distinct()
    right = first(spread(members).select("g", F.col("__s").alias("z"), "id", *kinds), ["g", "z"], ["id"])
    alike = left.join(near, "__s").join(right.hint("merge"), ["g", "z"]).select("g", "__s", "id", *kinds, "shared", "n")
    some = first(right.withColumn("none", none("z")), ["g", "none"], ["id"])
    other = left.join(some.hint("merge"), "g").join(near.select("__s", "z"), ["__s", "z"], "left_anti")
    other = other.select("g", "__s", "id", *kinds, F.when(~none("__s") & ~none("z"), 0).alias("shared"), F.when(~none("__s") & ~none("z"), 1).alias("n"))
    best = first(alike.unionByName(other), ["g", "__s"], [F.desc(ratio(F.col("shared"), F.col("n"))), F.col("id")])
    best = materialize(best.groupBy("g", "__s").agg(F.collect_list(F.struct("id", *kinds, "shared", "n")).alias("found")), "best")

    agrees = [F.col("k").bitwiseAND(F.lit(1 << i)) != 0 for i in range(len(kinds))]
    exact = lambda x: functools.reduce(lambda a, ic: a & (F.coalesce(x[ic[1]] == F.col(ic[1]), F.lit(False)) == agrees[ic[0]]), enumerate(kinds), F.lit(True))

    def scored(x: Column) -> Column:
        s = score(x["shared"], x["n"], agrees)
        return F.struct(F.when(s.isNull(), 2).when(F.isnan(s), 0).otherwise(1).alias("rank"), F.when(s.isNotNull() & ~F.isnan(s), -s).alias("down"), x["id"].alias("id"), s.alias("score"))

    classes = spread(members.select(*key).distinct()).join(best.hint("merge"), ["g", "__s"])
    classes = classes.select(*key, F.transform(F.filter("found", exact), scored).alias("found")).groupBy(*key).agg(F.flatten(F.collect_list("found")).alias("found"))
    classes = materialize(classes.select(*key, F.slice(F.array_sort("found"), 1, keep).alias("found")), "classes")
    on = [F.col("a.__b") == F.col("c.__b"), F.col("a.__s") == F.col("c.__s"), *[F.col(f"a.{c}").eqNullSafe(F.col(f"c.{c}")) for c in kinds]]
    pairs = base.select(ids, *key).alias("a").join(classes.hint("merge").alias("c"), on).select(F.col(ids).alias("left_id"), "found")
    pairs = pairs.select("left_id", F.explode(F.slice(F.filter("found", lambda x: x["id"] != F.col("left_id")), 1, 2)).alias("x"))
    return pairs.select("left_id", F.col("x.id").alias("right_id"), F.col("x.score").alias("score"))


def score_top2(pairs: DataFrame, left_id: str, right_id: str, score: Column, least: float = 40.0, lead: float = 2.0, sure: float = 85.0) -> DataFrame:
    """Best candidate per row: unmatched below `least`; ambiguous when the lead over the second is small and the best is not sure."""
    scored = pairs.withColumn("score", score)
    own = Window.partitionBy(left_id).orderBy(F.desc("score"), right_id)
    ranked = scored.withColumn("__n", F.row_number().over(own)).where("__n <= 2")
    best = ranked.groupBy(left_id).agg(F.max(F.when(F.col("__n") == 1, F.col(right_id))).alias(right_id), F.max(F.when(F.col("__n") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("__n") == 2, F.col("score"))).alias("second"))
    status = F.when(F.col("score") < least, "unmatched").when((F.col("score") - F.coalesce("second", F.lit(0.0)) <= lead) & (F.col("score") < sure), "ambiguous").otherwise("matched")
    return best.select(left_id, right_id, F.round("score", 2).alias("score"), F.round("second", 2).alias("second"), status.alias("status"))


def identity_key(parts: list[tuple[str, list[str]]]) -> Column:
    """First tier whose columns are all filled: prefix and sha1 of the lower-case parts."""
    out = None
    for prefix, columns in parts:
        filled = F.lit(True)
        for c in columns:
            filled = filled & clean(F.col(c).cast("string")).isNotNull()
        key = F.concat(F.lit(prefix + ":"), F.substring(F.sha1(F.lower(F.concat_ws("|", *[F.trim(F.col(c).cast("string")) for c in columns])).cast("binary")), 1, 16))
        out = F.when(filled, key) if out is None else out.when(filled, key)
    return out.otherwise(F.lit("unknown"))


def cross_role(sides: list[tuple[str, DataFrame]], key: list[str], amount: str, least_roles: int = 2) -> DataFrame:
    """Organizations by role: each side is summed first, then united and pivoted; only those with at least `least_roles` roles."""
    union = None
    for role, df in sides:
        own = df.groupBy(*key).agg(F.round(F.sum(amount), 2).alias("amount")).withColumn("role", F.lit(role))
        union = own if union is None else union.unionByName(own)
    sums = [F.round(F.coalesce(F.sum(F.when(F.col("role") == r, F.col("amount"))), F.lit(0.0)), 2).alias(f"{r}_amount") for r, _ in sides]
    return union.groupBy(*key).agg(*sums, F.countDistinct("role").alias("roles")).where(F.col("roles") >= least_roles)
