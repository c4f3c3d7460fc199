"""Matching jobs across registers: names by token Jaccard, addresses by state, zip and trigrams of the name."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.text import tokens, trigrams, zip5
from ledgerlens.operators.matching import overlap_join

_MARK = "\x1f"


def _best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def match_names(left: DataFrame, right: DataFrame, left_name: str, right_name: str, threshold: float = 0.8, best: list[str] | None = None) -> DataFrame:
    """Rows of left and right (no common column names) whose names have a token Jaccard of at least the threshold, with `score`.

    Names are compared once each, however many rows bear them; null names and names of stop words only match nothing. With `best`, one row per those
    columns stays: the highest score, then the smallest names.
    """
    names = lambda df, c, to: df.select(F.col(c).alias(to), tokens(F.col(c)).alias("tokens")).where(F.col(to).isNotNull() & (F.size("tokens") > 0)).distinct()
    found = overlap_join(names(left, left_name, "left_id"), names(right, right_name, "right_id"), threshold)
    out = left.join(found.select(F.col("left_id").alias(left_name), "right_id", "score"), left_name).join(right.withColumnRenamed(right_name, "right_id"), "right_id").withColumnRenamed("right_id", right_name)
    out = out.select(*left.columns, *right.columns, "score")
    return _best(out, best, [F.desc("score"), F.col(left_name), F.col(right_name)]) if best else out


def place_score(same_city: Column, same_zip: Column) -> Column:
    """Of rows in one state: 1.0 same zip and city, 0.7 same zip, 0.5 same city, else 0.2."""
    return F.when(same_zip & same_city, 1.0).when(same_zip, 0.7).when(same_city, 0.5).otherwise(0.2)


def _ids(table: pa.Table, columns: list[str]) -> np.ndarray:
    """A number for each row that is equal where all columns are; nulls are equal."""
    out = np.zeros(len(table), np.int64)
    for c in columns:
        own = table[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        out = np.unique(out * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
    return out


def _compare(threshold: float, names: tuple[str, str], keys: tuple[list[str], list[str]], keep: tuple[list[str], list[str]]):
    """Function of two tables of one block with `__t` (distinct trigrams) and `__c` (city): pairs at or above the threshold, the best of each pair of keys."""

    def function(a: pa.Table, b: pa.Table) -> pa.Table:
        lists = [t["__t"].combine_chunks() for t in (a, b)]
        size = [x.value_lengths().to_numpy() for x in lists]
        vocabulary = lists[0].flatten().unique()
        bits = []
        for x, n in zip(lists, size):
            code = pc.index_in(x.flatten(), value_set=vocabulary)
            known = code.is_valid().to_numpy(zero_copy_only=False)
            own = np.zeros((len(n), len(vocabulary)), np.float32)
            own[np.repeat(np.arange(len(n)), n)[known], code.drop_null().to_numpy()] = 1
            bits.append(own)
        shared = np.rint(bits[0] @ bits[1].T).astype(np.int64)
        union = np.maximum(size[0][:, None].astype(np.int64) + size[1][None, :] - shared, 1)
        i, j = np.nonzero(shared / union >= threshold)
        shared, union = shared[i, j], union[i, j]
        score = (20_000 * shared + union) // (2 * union)  # four digits, half up
        city = pa.chunked_array([*a["__c"].chunks, *b["__c"].chunks], pa.string()).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        same = (city[: len(a)][i] == city[len(a) :][j]) & (city[: len(a)][i] >= 0)
        if keys[0]:
            left, right = _ids(a, keys[0])[i], _ids(b, keys[1])[j]
            rank = [pc.rank(t[n].combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64) for t, n in ((a, names[0]), (b, names[1]))]
            by = np.lexsort((rank[1][j], rank[0][i], ~same, -score, right, left))
            first = np.ones(len(by), bool)
            first[1:] = (left[by][1:] != left[by][:-1]) | (right[by][1:] != right[by][:-1])
            by = by[first]
            i, j, score, same = i[by], j[by], score[by], same[by]
        found = [*a.select(keep[0]).take(i).columns, *b.select(keep[1]).take(j).columns, pa.array(np.where(same, 1.0, 0.7)), pa.array(score / 10_000)]
        return pa.table(found, names=[*keep[0], *keep[1], "address_score", "name_score"])

    return function


def match_addresses(left: DataFrame, right: DataFrame, left_name: str, right_name: str, place: tuple[tuple[str, str, str], tuple[str, str, str]], threshold: float, keys: list[str], keep: list[str] | None = None, tile: int = 1024) -> DataFrame:
    """Rows in the same state and five-digit zip whose names have a trigram similarity of at least the threshold; one row per `keys`, the most similar.

    place: city, state and zip columns of both sides. Adds `address_score` and `name_score`. Null states and zips match nothing; `keep` are the columns to return.
    All pairs of a block (state and zip) are compared as products of bit matrices; a crowded block is cut into tiles of about `tile` rows a side, in which equal
    keys stay together. The best row per keys is thus found in its tile; only left keys that stand in several blocks need the comparison of all their rows.
    """
    kept = [[c for c in df.columns if keep is None or c in keep] for df in (left, right)]
    own_keys = [[c for c in keys if c in df.columns] for df in (left, right)]

    def blocked(df: DataFrame, name: str, p: tuple[str, str, str]) -> DataFrame:
        rows = df.where(F.col(name).isNotNull() & F.col(p[1]).isNotNull() & (zip5(F.col(p[2])) != ""))
        return rows.withColumn("__b", F.concat_ws(_MARK, F.upper(F.trim(p[1])), zip5(F.col(p[2]))))

    a, b = blocked(left, left_name, place[0]), blocked(right, right_name, place[1])
    whole = all(own_keys)
    if whole:
        own = Window.partitionBy(*own_keys[0])
        a = a.withColumn("__many", F.min("__b").over(own) != F.max("__b").over(own))

    needed = [list(dict.fromkeys([*kept[k], *own_keys[k], name])) for k, name in enumerate((left_name, right_name))]

    def pairs(a: DataFrame, inside: bool) -> DataFrame:
        out = kept if inside else needed
        tiles = a.groupBy("__b").agg(F.ceil(F.count("*") / tile).alias("__m")).join(b.groupBy("__b").agg(F.ceil(F.count("*") / tile).alias("__n")), "__b")

        def dealt(df: DataFrame, k: int, name: str, city: str) -> DataFrame:
            mine, others = (("__m", "__i"), ("__n", "__j"))[:: -1 if k else 1]
            rows = df.join(tiles, "__b").withColumn(mine[1], F.pmod(F.xxhash64(*[F.col(c) for c in own_keys[k] or [name]]), F.col(mine[0])))
            rows = rows.withColumn(others[1], F.explode(F.sequence(F.lit(0).cast("long"), F.col(others[0]) - 1)))
            return rows.select(*needed[k], "__b", "__i", "__j", trigrams(F.lower(name)).alias("__t"), F.lower(F.trim(city)).alias("__c")).groupBy("__b", "__i", "__j")

        fields = [df.schema[c] for df, cs in ((left, out[0]), (right, out[1])) for c in cs]
        schema = T.StructType([*fields, T.StructField("address_score", T.DoubleType()), T.StructField("name_score", T.DoubleType())])
        compare = _compare(threshold, (left_name, right_name), tuple(own_keys) if inside else ([], []), tuple(out))
        return dealt(a, 0, left_name, place[0][0]).cogroup(dealt(b, 1, right_name, place[1][0])).applyInArrow(compare, schema)

    order = [F.desc("name_score"), F.desc("address_score"), F.col(left_name), F.col(right_name)]
    columns = [*kept[0], *kept[1], "address_score", "name_score"]
    found = [pairs(a.where(~F.col("__many")), True)] if whole else []
    found.append(_best(pairs(a.where("__many") if whole else a, False), keys, order).select(*columns))
    return reduce(DataFrame.unionByName, found)


def largest(donors: DataFrame, n: int = 50_000) -> DataFrame:
    """The donors that the client job looks at: the `n` of the largest totals."""
    return donors.orderBy(F.desc("total_amount"), "donor_key").limit(n)


def stack_addresses(orgs: DataFrame, kinds: tuple[str, ...] = ("", "custodian_", "contact_", "business_")) -> DataFrame:
    """(ein, org_name, address_type, org_city, org_state, org_zip): one row per organization and kind of address that it has."""
    parts = [
        orgs.select("ein", "org_name", F.lit(k.rstrip("_") or "org").alias("address_type"), *[F.col(k + c).alias(f"org_{c}") for c in ("city", "state", "zip")])
        for k in kinds
    ]
    return reduce(DataFrame.unionByName, parts).where("org_state IS NOT NULL AND org_zip IS NOT NULL").distinct()
