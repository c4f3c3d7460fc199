"""Graph operators over edge tables (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.sources.shared import materialize


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight").unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "weight"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    return endpoints(edges).groupBy("node").agg(F.round(F.sum("weight"), 2).alias("weighted_degree"), F.countDistinct("other").alias("degree"))


def bridge_ratio(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per node: share of its edges that cross labels, of those with both labels known; null without a label."""
    known = labels.select("node", "label")
    both = endpoints(edges).join(known, "node", "left").join(known.select(F.col("node").alias("other"), F.col("label").alias("other_label")), "other", "left")
    usable = F.col("label").isNotNull() & F.col("other_label").isNotNull()
    out = both.groupBy("node", "label").agg(F.sum(F.when(usable & (F.col("label") != F.col("other_label")), 1).otherwise(0)).alias("x"), F.sum(F.when(usable, 1).otherwise(0)).alias("n"))
    return out.select("node", F.when(F.col("label").isNotNull() & (F.col("n") > 0), F.round(F.col("x") / F.col("n"), 4)).alias("bridge_ratio"), F.col("n").alias("known_edges"))


def shared_pairs(edges: DataFrame, member: str, group: str, amount: str, min_shared: int = 1, min_amount: float = 0.0, top: int | None = None, digits: int = 2, members: DataFrame | None = None, times: str | None = None) -> DataFrame:
    """Unordered pairs of members with shared groups: count, and the sum of the smaller amounts.

    edges has one row per (member, group). What a group can make is bounded by the definition: `top` keeps each group's largest members by amount, `members`
    (one column, a pool of bounded size) only those, by number, so that a pair is a few bytes.
    `times`: a column that says how many equal groups a group stands for.
    """
    rows = edges.select(F.col(member).alias("m"), F.col(group).alias("g"), F.col(amount).alias("a"), (F.col(times) if times else F.lit(1)).cast("long").alias("k"))
    names = None
    if members is not None:  # pairs of numbers in the order of the names are far smaller than pairs of names
        pool = members.select(F.col(members.columns[0]).alias("m")).distinct()
        names = materialize(pool.withColumn("i", F.row_number().over(Window.orderBy("m"))), "pool")
        rows = rows.join(F.broadcast(names), "m").select(F.col("i").alias("m"), "g", "a", "k")
    if top:
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("a"), "m"))).where(F.col("__n") <= top).drop("__n")
    if top:  # a short sorted array per group, from which its pairs are made in place
        lists = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("m", "a"))).alias("xs"), F.max("k").alias("k")).where(F.size("xs") > 1)
        first = lists.select("k", "xs", F.posexplode("xs").alias("i", "x"))
        pairs = first.select("k", "x", F.explode(F.slice("xs", F.col("i") + 2, F.size("xs"))).alias("y")).select("k", F.col("x.m").alias("m1"), F.col("x.a").alias("a1"), F.col("y.m").alias("m2"), F.col("y.a").alias("a2"))
    else:
        left, right = rows.select("g", "k", F.col("m").alias("m1"), F.col("a").alias("a1")), rows.select(F.col("g").alias("h"), F.col("m").alias("m2"), F.col("a").alias("a2"))
        pairs = left.join(right, (F.col("g") == F.col("h")) & (F.col("m1") < F.col("m2")))
    found = pairs.groupBy("m1", "m2").agg(F.sum("k").alias("shared"), F.round(F.sum(F.col("k") * F.least("a1", "a2")) + F.lit(5e-7), digits).alias("weight"))
    found = found.where((F.col("shared") >= min_shared) & (F.col("weight") >= min_amount))
    if names is None:
        return found
    name = lambda k: F.broadcast(names.select(F.col("i").alias(f"m{k}"), F.col("m").alias(f"__{k}")))
    return found.join(name(1), "m1").join(name(2), "m2").select(F.col("__1").alias("m1"), F.col("__2").alias("m2"), "shared", "weight")


def largest(edges: DataFrame, key: str, n: int, amount: str = "total_amount") -> DataFrame:
    """The n keys of the largest sums."""
    return edges.groupBy(key).agg(F.round(F.sum(amount), 2).alias("__s")).orderBy(F.desc("__s"), key).limit(n).select(key)


def heaviest(pairs: DataFrame, n: int) -> DataFrame:
    return pairs.orderBy(F.desc("weight"), F.desc("shared"), "m1", "m2").limit(n)


def candidate_money(edges: DataFrame, links: DataFrame) -> DataFrame:
    """(donor_key, candidate_id, amount): a committee's gift split over its linked candidates."""
    return candidate_money_of(edges, links, links)


def candidate_money_of(edges: DataFrame, links: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same for the wanted links only; a gift is still split over all links of the committee."""
    own = lambda df: df.where("candidate_id IS NOT NULL").select("committee_id", "candidate_id").distinct()
    counts = own(links).groupBy("committee_id").agg(F.count("*").alias("n"))
    rows = edges.join(own(wanted), "committee_id").join(counts, "committee_id")
    return rows.groupBy("donor_key", "candidate_id").agg(F.round(F.sum(F.col("total_amount") / F.col("n")), 6).alias("amount"))


def cogiving(edges: DataFrame, links: DataFrame, donor_limit: int = 800, edge_limit: int = 1200, min_amount: float = 5000.0, min_shared: int = 2) -> DataFrame:
    """Pairs of the largest donors by shared targets: committees in one pass, linked candidates (gifts split) in another.

    Each pass has its own minima and keeps its 4 x edge_limit heaviest pairs; the passes are added, so that one gift may count in both, and the heaviest edge_limit stay.
    """
    edges = edges.select("donor_key", "committee_id", "total_amount")
    pool = largest(edges, "donor_key", donor_limit)
    few = edges.join(F.broadcast(pool), "donor_key", "left_semi")
    committees = heaviest(shared_pairs(few, "donor_key", "committee_id", "total_amount", min_shared, min_amount, members=pool), 4 * edge_limit)
    # Candidates with the same committees get the same money of every donor: one stands for all of them.
    own = links.where("candidate_id IS NOT NULL").select("committee_id", "candidate_id").distinct()
    alike = own.groupBy("candidate_id").agg(F.array_sort(F.collect_list("committee_id")).alias("cs")).groupBy("cs").agg(F.min("candidate_id").alias("candidate_id"), F.count("*").alias("k"))
    money = candidate_money_of(few, own, alike.select("candidate_id", F.explode("cs").alias("committee_id"))).join(alike.select("candidate_id", "k"), "candidate_id")
    candidates = heaviest(shared_pairs(money, "donor_key", "candidate_id", "amount", min_shared, min_amount, members=pool, times="k"), 4 * edge_limit)
    zero = F.lit(0).cast("long")
    both = committees.select("m1", "m2", F.col("shared").alias("c"), zero.alias("k"), "weight").unionByName(candidates.select("m1", "m2", zero.alias("c"), F.col("shared").alias("k"), "weight"))
    merged = both.groupBy("m1", "m2").agg(F.sum("c").alias("shared_committees"), F.sum("k").alias("shared_candidates"), F.sum(F.col("c") + F.col("k")).alias("shared"), F.round(F.sum("weight"), 2).alias("weight"))
    return heaviest(merged, edge_limit)


def similarity(edges: DataFrame, committee_limit: int = 500, edge_limit: int = 1200, min_shared: int = 3, min_amount: float = 10_000.0) -> DataFrame:
    """Pairs of the largest committees by shared donors, of the largest donors (six for each committee of the limit, 600 to 6,000)."""
    edges = edges.select("donor_key", "committee_id", "total_amount")
    pool = largest(edges, "committee_id", committee_limit)
    few = edges.join(F.broadcast(largest(edges, "donor_key", min(max(committee_limit * 6, 600), 6_000))), "donor_key", "left_semi")
    return heaviest(shared_pairs(few, "committee_id", "donor_key", "total_amount", min_shared, min_amount, members=pool), edge_limit)


def competition(edges: DataFrame, links: DataFrame, candidate_limit: int = 250, edge_limit: int = 1200, min_shared: int = 2, min_amount: float = 2_500.0, top: int = 20) -> DataFrame:
    """Pairs of candidates by shared donors: the largest donors (25 for each candidate of the limit, 1,500 to 8,000), the largest candidates among them, each donor's `top` candidates."""
    edges = edges.select("donor_key", "committee_id", "total_amount")
    few = edges.join(F.broadcast(largest(edges, "donor_key", min(max(candidate_limit * 25, 1_500), 8_000))), "donor_key", "left_semi")
    # A candidate's sum over all donors is the sum of its committees' shares: no donor is needed to choose the candidates.
    totals = candidate_money(few.groupBy(F.lit("all").alias("donor_key"), "committee_id").agg(F.sum("total_amount").alias("total_amount")), links)
    own = candidate_money_of(few, links, links.join(F.broadcast(largest(totals, "candidate_id", candidate_limit, "amount")), "candidate_id", "left_semi")).where("amount > 0")
    return heaviest(shared_pairs(own, "candidate_id", "donor_key", "amount", min_shared, min_amount, top=top), edge_limit)


def hops(edges: DataFrame, start: DataFrame, max_hops: int = 3) -> DataFrame:
    """(node, hop) by breadth-first search over undirected edges; start has a `node` column. Each round visits new nodes only."""
    both = materialize(endpoints(edges).select("node", "other").distinct(), "adjacent")
    seen = start.select("node").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, max_hops + 1):
        near = front.select("node").join(both, "node").select(F.col("other").alias("node")).distinct()
        front = materialize(near.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)), "hops")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, by minimum labels with pointer jumping. Nodes without edges are not listed."""
    both = materialize(endpoints(edges.withColumn("weight", F.lit(1.0))).select("node", "other").distinct(), "edges")
    label = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component"))
    while True:  # labels only fall, so this ends
        label = materialize(label, "labels")
        near = both.join(label.select(F.col("node").alias("other"), F.col("component").alias("c")), "other").groupBy("node").agg(F.min("c").alias("c"))
        lower = label.join(near, "node").select("node", "component", F.least("component", "c").alias("next"))
        jumped = lower.join(label.select(F.col("node").alias("next"), F.col("component").alias("jump")), "next").select("node", "component", F.least("next", "jump").alias("next"))
        after = materialize(jumped, "labels")
        if after.where("next <> component").isEmpty():
            break
        label = after.select("node", F.col("next").alias("component"))
    return label


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 25) -> DataFrame:
    """Weighted PageRank on undirected edges, sinks spread evenly, divided by the maximum; every few rounds are written out."""
    both = endpoints(edges).groupBy("node", "other").agg(F.sum("weight").alias("w"))
    out = both.groupBy("node").agg(F.sum("w").alias("total"))
    share = materialize(both.join(out, "node").where("total > 0").select("node", "other", (F.col("w") / F.col("total")).alias("p")), "shares")
    nodes = materialize(out.select("node", (F.col("total") <= 0).alias("sink")), "nodes")
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    rank = nodes.select("node", "sink", F.lit(1.0 / n).alias("rank"))
    for i in range(rounds):
        lost = rank.where("sink").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        got = share.join(rank.select("node", "rank"), "node").groupBy("other").agg(F.sum(F.col("p") * F.col("rank")).alias("got"))
        rank = nodes.join(got, nodes["node"] == got["other"], "left").crossJoin(F.broadcast(lost)).select(
            "node", "sink", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank")
        )
        if i % 5 == 4:
            rank = materialize(rank, "rank")
    top = rank.agg(F.max("rank").alias("top"))
    return rank.crossJoin(F.broadcast(top)).select("node", F.round(F.col("rank") / F.col("top"), 6).alias("rank"))


def influence(degrees: DataFrame, ranks: DataFrame, kinds: DataFrame) -> DataFrame:
    """0.55 weight + 0.25 degree + 0.20 PageRank; weight and degree relative to the maximum of the node's kind, PageRank to that of all."""
    rows = degrees.join(ranks, "node").join(kinds, "node")
    own = Window.partitionBy("kind")
    top = rows.agg(F.max("rank").alias("top"))
    score = 0.55 * F.col("weighted_degree") / F.max("weighted_degree").over(own) + 0.25 * F.col("degree") / F.max("degree").over(own) + 0.20 * F.col("rank") / F.col("top")
    return rows.crossJoin(F.broadcast(top)).select("node", "kind", F.round(score, 4).alias("influence"))


def metrics(edges: DataFrame, labels: DataFrame, sources: int = 32, seed: int = 42) -> DataFrame:
    """One row per node: degrees, sampled betweenness, community and bridge ratio."""
    from ledgerlens.operators import kernels

    out = degree_centrality(edges).join(kernels.betweenness(edges), "node", "left").join(kernels.louvain(edges), "node", "left")
    return out.join(bridge_ratio(edges, labels), "node", "left")


def capped_layers(layers: dict[str, DataFrame], per_layer: int, cap: int) -> DataFrame:
    """Edges (src, dst, weight) of several layers: the heaviest of each, then the heaviest of all."""
    union = None
    for name, df in layers.items():
        own = df.select(F.lit(name).alias("layer"), "src", "dst", "weight").orderBy(F.desc("weight"), "src", "dst").limit(per_layer)
        union = own if union is None else union.unionByName(own)
    return union.orderBy(F.desc("weight"), "layer", "src", "dst").limit(cap)


def ego(edges: DataFrame, node: str, caps: dict[str, int]) -> DataFrame:
    """Edges at a node, per type the largest up to its cap, the rest folded into one `other` edge per type; weights are rounded first."""
    own = edges.where((F.col("src") == node) | (F.col("dst") == node)).withColumn("weight", F.round("weight", 2))
    other = F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src"))
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    ranked = own.withColumn("other", other).withColumn("__n", F.row_number().over(Window.partitionBy("edge_type").orderBy(F.desc("weight"), "other")))
    keep = F.col("__n") <= F.coalesce(F.element_at(cap, F.col("edge_type")), F.lit(10))
    return ranked.groupBy("edge_type", F.when(keep, F.col("other")).otherwise("other").alias("other")).agg(F.round(F.sum("weight"), 2).alias("weight"), F.count("*").alias("edges"))


def channel_graph(edges: DataFrame, channels: list[str]) -> DataFrame:
    """Per node a bit mask of its channels, its size (sum of log1p of money and of links) and months active."""
    bit = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(channels) for x in (c, 1 << i)]), F.col("channel"))
    ends = edges.select(F.col("src").alias("node"), "channel", "weight", "month").unionByName(edges.select(F.col("dst").alias("node"), "channel", "weight", "month"))
    return ends.groupBy("node").agg(
        F.bit_or(bit).cast("int").alias("channel_mask"), F.round(F.log1p(F.sum("weight")) + F.log1p(F.count("*")), 4).alias("size"), F.countDistinct("month").alias("months")
    )
