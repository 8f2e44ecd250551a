"""Pattern, neighbourhood and traversal operators over (src, dst, rel_type) edges.

Operators take and give DataFrames. Every limit has a total order. Loops keep
their state in checkpoints, so plans stay short however deep the walk.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import shared_folder


def kept(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge seen from both ends: node, other, rel_type, is_outgoing; a
    self-loop is seen once."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "rel_type", F.lit(True).alias("is_outgoing"))
    back = edges.filter(F.col("src") != F.col("dst")).select(F.col("dst").alias("node"), F.col("src").alias("other"), "rel_type", F.lit(False).alias("is_outgoing"))
    return out.unionByName(back)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group in ``order`` (a total order)."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")


def one_hop(seeds: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """Neighbours of ``seeds`` (node) with the direction of each edge."""
    found = undirected(edges).join(seeds, "node")
    return top_per_group(found, ["node"], [F.col("rel_type"), F.col("other"), F.col("is_outgoing")], limit)


def neighbours(seeds: DataFrame, edges: DataFrame, limit: int = 30) -> DataFrame:
    """Distinct undirected neighbours of ``seeds``."""
    found = undirected(edges).join(seeds, "node").select("node", "other", "rel_type").distinct()
    return top_per_group(found, ["node"], [F.col("rel_type"), F.col("other")], limit)


def outgoing_collected(heads: DataFrame, edges: DataFrame) -> DataFrame:
    """Outgoing edges collected per head; heads without any keep one null entry."""
    joined = heads.join(edges.withColumnRenamed("src", "node"), "node", "left")
    pairs = F.array_sort(F.collect_list(F.struct("rel_type", "dst")))
    return joined.groupBy("node").agg(pairs.alias("links"))


def in_out_collected(heads: DataFrame, edges: DataFrame) -> DataFrame:
    """Incoming and outgoing neighbours, each aggregated before its join."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("outgoing"))
    inc = edges.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("incoming"))
    empty = F.array().cast("array<string>")
    return heads.join(out, "node", "left").join(inc, "node", "left").select(
        "node", F.coalesce("outgoing", empty).alias("outgoing"), F.coalesce("incoming", empty).alias("incoming")
    )


PATTERN = re.compile(r"^\s*(\?|[^\[\]]+?)\s*-\[\s*(\*\s*\d+|\?|\w+)\s*\]->\s*(\?|[^\[\]]+?)\s*$")


def pattern(text: str, edges: DataFrame, limit: int = 20) -> DataFrame:
    """Compile ``A -[T]-> ?``, ``? -[T]-> B``, ``A -[?]-> B`` or
    ``A -[*N]-> ?`` into a plan. Raises ValueError for any other text."""
    m = PATTERN.match(text)
    if not m:
        raise ValueError(f"not a relationship pattern: {text!r}")
    a, rel, b = (x.strip() for x in m.groups())
    if rel.startswith("*"):
        if a == "?":
            raise ValueError("a path pattern needs a first entity")
        seeds = edges.sparkSession.createDataFrame([(a,)], "node string")
        return paths(seeds, edges, int(rel[1:])).orderBy("hops", "chain", "node").limit(limit)
    found = edges
    if a != "?":
        found = found.filter(F.col("src") == a)
    if b != "?":
        found = found.filter(F.col("dst") == b)
    if rel != "?":
        found = found.filter(F.col("rel_type") == rel)
    return found.orderBy("rel_type", "src", "dst").limit(limit)


def paths(seeds: DataFrame, edges: DataFrame, max_hops: int) -> DataFrame:
    """All directed walks of 1 to ``max_hops`` edges that repeat no edge:
    start, node (the end), hops, chain of relation types."""
    e = edges.distinct().select(F.col("src").alias("node"), F.col("dst").alias("next"), "rel_type")
    state = seeds.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops"), F.array().cast("array<string>").alias("used"), F.array().cast("array<string>").alias("types"))
    out = None
    for _ in range(max_hops):
        step = F.concat_ws("|", "node", "rel_type", "next")
        state = (
            state.join(e, "node").filter(~F.array_contains("used", step))
            .select("start", F.col("next").alias("node"), (F.col("hops") + 1).alias("hops"), F.concat("used", F.array(step)).alias("used"), F.concat("types", F.array("rel_type")).alias("types"))
        )
        out = state if out is None else out.unionByName(state)
    return out.select("start", "node", "hops", F.concat_ws(">", "types").alias("chain"))


def within_hops(seeds: DataFrame, edges: DataFrame, max_hops: int, cap: int | None = None) -> DataFrame:
    """Nodes by the least number of undirected hops (level 0 is
    the seeds); ``cap`` keeps the first nodes of a level in id order."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct().toDF("node", "next")
    visited = kept(seeds.select("node").distinct().withColumn("level", F.lit(0)))
    frontier = visited
    for level in range(1, max_hops + 1):
        new = frontier.select("node").join(both, "node").select(F.col("next").alias("node")).distinct().join(visited, "node", "left_anti")
        if cap is not None:
            new = new.orderBy("node").limit(cap)
        frontier = kept(new.withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def bfs_out(seeds: DataFrame, edges: DataFrame, max_depth: int, cap: int | None = None) -> DataFrame:
    """Breadth-first levels along edge direction from each seed: seed, node, level."""
    e = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    visited = kept(seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("level", F.lit(0)))
    frontier = visited
    for level in range(1, max_depth + 1):
        new = frontier.join(e, "node").select("seed", F.col("next").alias("node")).distinct().join(visited, ["seed", "node"], "left_anti")
        if cap is not None:
            new = top_per_group(new, ["seed"], [F.col("node")], cap)
        frontier = kept(new.withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def shortest_pairs(pairs: DataFrame, edges: DataFrame, max_hops: int) -> DataFrame:
    """Least undirected distance of each (a, b) pair, null beyond ``max_hops``."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    reach = bfs_out(pairs.select(F.col("a").alias("node")), both, max_hops).select(F.col("seed").alias("a"), F.col("node").alias("b"), F.col("level").alias("distance"))
    return pairs.join(reach, ["a", "b"], "left")


def connectivity_ratio(sets: DataFrame, edges: DataFrame, max_hops: int) -> DataFrame:
    """Connected pairs over all pairs of each set (set_id, node); below two nodes 1.0."""
    a, b = sets.toDF("set_id", "a"), sets.toDF("set_id", "b")
    pairs = a.join(b, "set_id").filter(F.col("a") < F.col("b"))
    found = shortest_pairs(pairs.select("a", "b").distinct(), edges, max_hops)
    per = pairs.join(found, ["a", "b"]).groupBy("set_id").agg(F.count("*").alias("pairs"), F.count("distance").alias("connected"))
    return sets.select("set_id").distinct().join(per, "set_id", "left").select(
        "set_id", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("connected", F.lit(0)).alias("connected"),
        F.coalesce(F.col("connected") / F.col("pairs"), F.lit(1.0)).alias("ratio"),
    )


def comembers(members: DataFrame) -> DataFrame:
    """Distinct ordered pairs (a, b) of nodes of the same group (grp, node)."""
    a, b = members.toDF("grp", "a"), members.toDF("grp", "b")
    return a.join(b, "grp").filter(F.col("a") != F.col("b")).select("a", "b", "grp").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Outgoing, incoming and total degree; a self-loop counts on both sides."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    inc = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    zero = F.lit(0).cast("long")
    return nodes.join(out, "id", "left").join(inc, "id", "left").withColumns({
        "out_degree": F.coalesce("out_degree", zero), "in_degree": F.coalesce("in_degree", zero),
    }).withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def abstraction(children: Column, parents: Column, instances: Column) -> Column:
    """Children - parents / 2, plus 10 with any instance."""
    return children - parents * 0.5 + F.when(instances > 0, 10.0).otherwise(0.0)


def is_root_like(children: Column, parents: Column, instances: Column, threshold: float = 5.0) -> Column:
    """A class with instances, a top concept, or a high abstraction score."""
    return (instances > 0) | ((parents <= 2) & (children >= 1)) | (abstraction(children, parents, instances) >= threshold)


def root_connectivity(edges: DataFrame, roots: DataFrame, subclass: str) -> DataFrame:
    """3 per direct link to a root, 2 per distinct root, 1.5 per subclass edge."""
    direct = edges.join(roots.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(
        F.count("*").alias("direct"), F.countDistinct("dst").alias("roots")
    )
    subs = edges.filter(F.col("rel_type") == subclass).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("subs"))
    score = 3.0 * F.col("direct") + 2.0 * F.col("roots") + 1.5 * F.coalesce("subs", F.lit(0))
    return direct.join(subs, "id", "left").select("id", score.alias("connectivity"))


def weighted_pairs(edges: DataFrame, weight: str) -> DataFrame:
    """One undirected edge per pair; a null or zero weight counts as 1."""
    w = F.when(F.col(weight).isNull() | (F.col(weight) == 0), F.lit(1.0)).otherwise(F.col(weight))
    return edges.filter(F.col("src") != F.col("dst")).groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.sum(w).alias("weight"))


def modularity(pairs: DataFrame, partition: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Weighted modularity of a partition (id, community): one row."""
    both = pairs.select("u", "v", "weight").union(pairs.select("v", "u", "weight"))
    named = both.join(partition.toDF("u", "cu"), "u").join(partition.toDF("v", "cv"), "v")
    per = named.groupBy(F.col("cu").alias("c")).agg(F.sum(F.when(F.col("cu") == F.col("cv"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("strength"))
    total = F.sum("strength").over(Window.partitionBy())
    return per.withColumn("m2", total).agg(F.sum(F.col("inside") / F.col("m2") - F.lit(resolution) * F.pow(F.col("strength") / F.col("m2"), F.lit(2.0))).alias("modularity"))


def label_propagation(pairs: DataFrame, rounds: int = 8) -> DataFrame:
    """Communities by synchronous weighted label propagation, ties to the least
    label, own label counted with the mean weight so that rounds settle."""
    both = kept(pairs.select(F.col("u").alias("id"), F.col("v").alias("other"), "weight").union(pairs.select(F.col("v"), F.col("u"), "weight")))
    own = both.groupBy("id").agg(F.avg("weight").alias("weight"))
    labels = both.select("id").distinct().withColumn("community", F.col("id"))
    for _ in range(rounds):
        votes = both.join(labels.toDF("other", "community"), "other").select("id", "community", "weight").unionByName(
            own.join(labels, "id").select("id", "community", "weight"))
        tally = votes.groupBy("id", "community").agg(F.round(F.sum("weight"), 9).alias("w"))
        best = tally.groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("w"), F.col("community"))).alias("b"))
        labels = kept(best.select("id", F.col("b.community").alias("community")))
    return labels


def louvain(pairs: DataFrame, resolution: float = 1.0, levels: int = 3, rounds: int = 6, seed: int = 42) -> DataFrame:
    """Communities (id, community) by Louvain's method in rounds: in each about
    half of the nodes (by a seeded hash, so that neighbours do not swap for ever)
    move to the neighbouring community of the highest modularity gain, ties to the
    least; when a level's moves end or its rounds are used up, its communities
    become the nodes of the next. ``pairs``: u, v, weight."""
    both = kept(pairs.select(F.col("u").alias("id"), F.col("v").alias("other"), "weight").union(pairs.select("v", "u", "weight")))
    strength = kept(both.groupBy("id").agg(F.sum("weight").alias("k")))
    total = strength.agg(F.sum("k").alias("m2")).first()["m2"]
    labels = strength.select("id", F.col("id").alias("community"))
    for level in range(levels):
        state = strength.select("id", "k", F.col("id").alias("c"))
        moved_any = False
        for r in range(rounds):
            sums = state.groupBy("c").agg(F.sum("k").alias("s"))
            near = both.join(state.select(F.col("id").alias("other"), "c"), "other").groupBy("id", "c").agg(F.sum("weight").alias("w"))
            own = state.select("id", "c", F.lit(0.0).alias("w"))
            options = near.unionByName(own).groupBy("id", "c").agg(F.sum("w").alias("w")).join(sums, "c").join(state.select("id", "k", F.col("c").alias("now")), "id")
            rest = F.col("s") - F.when(F.col("c") == F.col("now"), F.col("k")).otherwise(0.0)
            gain = F.round(F.col("w") - F.lit(resolution) * F.col("k") * rest / F.lit(total), 9)
            scored = options.withColumn("gain", gain)
            best = scored.groupBy("id").agg(
                F.min(F.struct((-F.col("gain")).alias("g"), "c")).alias("b"), F.max(F.when(F.col("c") == F.col("now"), F.col("gain"))).alias("stay"), F.first("k").alias("k"), F.first("now").alias("now"))
            turn = F.pmod(F.xxhash64(F.lit(seed + r), "id"), F.lit(2)) == 0
            move = turn & (-F.col("b.g") > F.col("stay"))
            state = kept(best.select("id", "k", F.when(move, F.col("b.c")).otherwise(F.col("now")).alias("c"), move.alias("moved")))
            moved = state.agg(F.count_if("moved").alias("n")).first()["n"]
            moved_any = moved_any or moved > 0
            if not moved and r:
                break
        if not moved_any:
            break
        names = state.select("id", "c")
        labels = kept(labels.join(names.toDF("community", "c"), "community").select("id", F.col("c").alias("community")))
        if level + 1 < levels:
            both = kept(both.join(names, "id").join(names.toDF("other", "d"), "other").filter("c <> d").groupBy(F.col("c").alias("id"), F.col("d").alias("other")).agg(F.sum("weight").alias("weight")))
            strength = kept(state.groupBy(F.col("c").alias("id")).agg(F.sum("k").alias("k")))
    return labels


def of_size(labels: DataFrame, least: int) -> DataFrame:
    """The members of communities of at least ``least`` members."""
    big = labels.groupBy("community").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("community")
    return labels.join(big, "community", "left_semi")


def components(edges: DataFrame, max_rounds: int = 100, keep: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """Connected components by alternating stars: id, component (the
    least id reachable), for every id of ``edges`` (src, dst).

    Links run from the larger to the smaller id. A round hooks every link onto the
    least neighbour of its smaller end, then all smaller ends of an id onto the
    least of them; links never become more, and whole trees are hooked, so rounds
    grow with the logarithm of a chain's length. It ends when every tree is a star
    and raises an error if ``max_rounds`` did not suffice.
    """
    pairs = keep(edges.select(F.greatest("src", "dst").alias("v"), F.least("src", "dst").alias("m")).filter("v is not null").distinct())
    links = pairs.filter("v <> m")
    for _ in range(max_rounds):
        both = links.select(F.col("m").alias("id"), F.col("v").alias("other")).union(links)
        least = both.groupBy(F.col("id").alias("m")).agg(F.least(F.col("m"), F.min("other")).alias("to"))
        large = keep(links.join(least, "m").select("v", F.col("to").alias("m")).distinct())
        least = large.groupBy("v").agg(F.min("m").alias("to"))
        small = large.join(least, "v").filter("m <> to").select(F.col("m").alias("v"), F.col("to").alias("m"))
        links = keep(least.toDF("v", "m").union(small).distinct())
        ends = links.select(F.col("v").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("m", F.lit(0), F.lit(1)))
        if ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = pairs.select(F.col("v").alias("id")).union(pairs.select("m")).distinct()
    return nodes.join(links.toDF("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
