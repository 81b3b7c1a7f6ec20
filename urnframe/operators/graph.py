"""Co-occurrence graphs: construction, centrality, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urnframe.functions.columns import rounded
from urnframe.operators.scan import last_draws
from urnframe.session import checkpoint_counted, checkpoint_frame


def cooccurrence(baskets: DataFrame) -> DataFrame:
    """Pair counts a < b.

    Pairs come from one basket array at a time, so they are counted map-side before the only
    shuffle, whose size is bounded by tasks x universe squared. A basket holds distinct numbers
    of the universe, which bounds its pairs.
    """
    ordered = baskets.select("lottery_id", F.sort_array("numbers").alias("_s"))
    # A basket is never empty; the outer form keeps Spark from sorting again for a size filter.
    first = ordered.select("lottery_id", "_s", F.posexplode_outer("_s").alias("_i", "a"))
    rest = F.explode(F.slice("_s", F.col("_i") + 2, F.size("_s")))
    return (
        first.select("lottery_id", "a", rest.alias("b"))
        .groupBy("lottery_id", "a", "b")
        .agg(F.count("*").alias("weight"))
    )


def cooccurrence_window(baskets: DataFrame, n: int) -> DataFrame:
    """Pair counts over the newest ``n`` draws."""
    return cooccurrence(last_draws(baskets.select("lottery_id", "draw_number", "numbers"), n))


def symmetric(pairs: DataFrame) -> DataFrame:
    """Both directions of every pair, from one read of it."""
    ends = F.explode(
        F.array(
            F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
            F.struct(F.col("b").alias("src"), F.col("a").alias("dst")),
        )
    )
    return pairs.select("lottery_id", ends.alias("e"), "weight").select("lottery_id", "e.*", "weight")


def cooccurrence_matrix(pairs: DataFrame, numbers: list[int] | None = None) -> DataFrame:
    """Symmetric long form, or one column per number when ``numbers`` is given."""
    both = symmetric(pairs)
    if numbers is None:
        return both
    wide = both.groupBy("lottery_id", "src").pivot("dst", numbers).agg(F.first("weight"))
    return wide.na.fill(0)


def weight_threshold(pairs: DataFrame, spread: float) -> DataFrame:
    """Per lottery: mean pair weight plus ``spread`` times its square root."""
    mean = F.avg("weight")
    return pairs.groupBy("lottery_id").agg((mean + spread * F.sqrt(mean)).alias("threshold"))


def adjacency(pairs: DataFrame, threshold) -> DataFrame:
    """Pairs at or above a threshold: one number, or a (lottery_id, threshold) table."""
    if isinstance(threshold, DataFrame):
        kept = pairs.join(threshold, "lottery_id").where(F.col("weight") >= F.col("threshold"))
        return kept.drop("threshold")
    return pairs.where(F.col("weight") >= threshold)


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Numbers that have an edge, ordered."""
    ends = edges.select("lottery_id", F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("lottery_id", "node").agg(F.count("*").alias("degree"))


def graph_edges(both: DataFrame) -> DataFrame:
    """Each undirected edge once."""
    kept = both.where(F.col("src") < F.col("dst"))
    return kept.select("lottery_id", F.col("src").alias("a"), F.col("dst").alias("b"), "weight")


def degree_centrality(edges: DataFrame) -> DataFrame:
    """Neighbours / (V - 1); 0 in a graph of one node."""
    nodes = graph_nodes(edges)
    size = F.count("*").over(W.partitionBy("lottery_id"))
    share = F.when(size > 1, F.col("degree") / (size - 1)).otherwise(F.lit(0.0))
    return nodes.select("lottery_id", "node", share.alias("value"))


def path_counts(edges: DataFrame) -> DataFrame:
    """All-pairs hop distance and number of shortest paths (lottery_id, src, dst, dist, paths).

    One frontier join per hop for all sources at once. Every round is checkpointed, so a lost
    executor never replays earlier rounds.
    """
    links = checkpoint_frame(symmetric(edges).select("lottery_id", "src", "dst"))
    step = links.select("lottery_id", F.col("src").alias("dst"), F.col("dst").alias("next"))
    frontier = (
        links.select("lottery_id", "src")
        .distinct()
        .select(
            "lottery_id",
            "src",
            F.col("src").alias("dst"),
            F.lit(0).alias("dist"),
            F.lit(1.0).alias("paths"),
        )
    )
    levels, hop = [frontier], 0
    while True:
        hop += 1
        reached = frontier.join(step, ["lottery_id", "dst"]).select(
            "lottery_id", "src", F.col("next").alias("dst"), "paths", F.lit(False).alias("_old")
        )
        # A neighbour of level k lies on level k - 1, k or k + 1, so two levels tell what is new.
        for level in levels[-2:]:
            reached = reached.unionByName(
                level.select("lottery_id", "src", "dst", "paths", F.lit(True).alias("_old"))
            )
        fresh = (
            reached.groupBy("lottery_id", "src", "dst")
            .agg(F.sum("paths").alias("paths"), F.max("_old").alias("_old"))
            .where(~F.col("_old"))
        )
        frontier, found = checkpoint_counted(
            fresh.select("lottery_id", "src", "dst", F.lit(hop).alias("dist"), "paths")
        )
        if not found:
            break
        levels.append(frontier)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def shortest_paths(edges: DataFrame) -> DataFrame:
    paths = path_counts(edges)
    return paths.where(F.col("dist") > 0).select("lottery_id", "src", "dst", "dist")


def closeness_centrality(paths: DataFrame) -> DataFrame:
    """(V - 1) / sum of distances; unreachable nodes add nothing, a sum of 0 gives 0."""
    sums = paths.groupBy("lottery_id", F.col("src").alias("node")).agg(F.sum("dist").alias("_d"))
    size = F.count("*").over(W.partitionBy("lottery_id"))
    value = F.when(F.col("_d") > 0, (size - 1) / F.col("_d")).otherwise(F.lit(0.0))
    return sums.select("lottery_id", "node", value.alias("value"))


def betweenness_centrality(edges: DataFrame, paths: DataFrame, normalized: bool = False):
    """Dependency sums over all ordered pairs, not halved.

    Works back from the farthest level: a node hands each predecessor its share of shortest
    paths times (1 + its own dependency).
    """
    links = checkpoint_frame(
        symmetric(edges).select("lottery_id", F.col("src").alias("pre"), F.col("dst").alias("dst"))
    )
    paths = checkpoint_frame(paths)
    top = paths.agg(F.max("dist")).first()[0] or 0
    level = paths.where(F.col("dist") == top).withColumn("dep", F.lit(0.0))
    parts = [level]
    for hop in range(top - 1, 0, -1):
        before = paths.where(F.col("dist") == hop)
        given = (
            level.select("lottery_id", "src", "dst", F.col("paths").alias("_p"), "dep")
            .join(links, ["lottery_id", "dst"])
            .select("lottery_id", "src", F.col("pre").alias("dst"), "_p", "dep")
            .join(before, ["lottery_id", "src", "dst"])
            .groupBy("lottery_id", "src", "dst")
            .agg(F.sum(F.col("paths") / F.col("_p") * (1 + F.col("dep"))).alias("dep"))
        )
        level = checkpoint_frame(
            before.join(given, ["lottery_id", "src", "dst"], "left").na.fill(0.0, ["dep"])
        )
        parts.append(level)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    totals = every.groupBy("lottery_id", F.col("dst").alias("node")).agg(F.sum("dep").alias("_b"))
    nodes = paths.where(F.col("dist") == 0).select("lottery_id", F.col("src").alias("node"))
    value = F.coalesce(F.col("_b"), F.lit(0.0))
    if normalized:
        size = F.count("*").over(W.partitionBy("lottery_id")).cast("double")
        value = F.when(size > 2, value / ((size - 1) * (size - 2))).otherwise(F.lit(0.0))
    return nodes.join(totals, ["lottery_id", "node"], "left").select(
        "lottery_id", "node", value.alias("value")
    )


def density(edges: DataFrame) -> DataFrame:
    """Edges / (V (V - 1) / 2); 0 in a graph of at most one node."""
    v = graph_nodes(edges).groupBy("lottery_id").agg(
        F.count("*").cast("double").alias("_v"), F.sum("degree").alias("_deg")
    )
    value = F.when(F.col("_v") > 1, F.col("_deg") / (F.col("_v") * (F.col("_v") - 1)))
    return v.select("lottery_id", F.coalesce(value, F.lit(0.0)).alias("value"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Newman Q: per community, inner weight share minus squared degree share."""
    of = communities.select("lottery_id", "node", "community")
    ends = edges.join(
        of.select("lottery_id", F.col("node").alias("a"), F.col("community").alias("ca")),
        ["lottery_id", "a"],
    ).join(
        of.select("lottery_id", F.col("node").alias("b"), F.col("community").alias("cb")),
        ["lottery_id", "b"],
    )
    side = F.explode(F.array("ca", "cb")).alias("community")
    inner = F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)
    sums = (
        ends.select("lottery_id", "weight", inner.alias("inner"), side)
        .groupBy("lottery_id", "community")
        .agg(F.sum("weight").cast("double").alias("k"), F.sum("inner").cast("double").alias("i"))
    )
    total = F.sum("k").over(W.partitionBy("lottery_id"))
    parts = sums.withColumn("q", F.col("i") / total - F.pow(F.col("k") / total, 2))
    return parts.groupBy("lottery_id").agg(F.sum("q").alias("value"))


def communities(edges: DataFrame) -> DataFrame:
    """Greedy modularity merging in rounds (lottery_id, node, community).

    In a round every community picks its best partner with a positive gain, ties going to the
    lower id, and mutual picks merge. The best pair of a lottery is always mutual, so every
    round raises modularity and the loop ends. The contracted graph shrinks round by round.
    """
    links = checkpoint_frame(symmetric(edges))
    total = links.groupBy("lottery_id").agg(F.sum("weight").cast("double").alias("m2"))
    total = checkpoint_frame(total)
    member = links.select("lottery_id", F.col("src").alias("node"), F.col("src").alias("c")).distinct()

    def relabel(df: DataFrame, merged: DataFrame, column: str) -> DataFrame:
        keys = merged.select("lottery_id", F.col("c").alias(column), "into")
        joined = df.join(keys, ["lottery_id", column], "left")
        return joined.withColumn(column, F.coalesce("into", column)).drop("into")

    while True:
        # Merged communities keep their inner weight as a loop, so degrees are sums of links.
        degrees = links.groupBy("lottery_id", F.col("src").alias("c")).agg(F.sum("weight").alias("k"))
        own = degrees.select("lottery_id", F.col("c").alias("src"), "k")
        other = degrees.select("lottery_id", F.col("c").alias("dst"), F.col("k").alias("k2"))
        gain = 2 * F.col("weight") / F.col("m2") - 2 * F.col("k") * F.col("k2") / (
            F.col("m2") * F.col("m2")
        )
        best = (
            links.where(F.col("src") != F.col("dst"))
            .join(own, ["lottery_id", "src"])
            .join(other, ["lottery_id", "dst"])
            .join(total, "lottery_id")
            .withColumn("gain", gain)
            .where(F.col("gain") > 0)
            .groupBy("lottery_id", "src")
            .agg(F.max_by("dst", F.struct("gain", -F.col("dst"))).alias("dst"))
        )
        # A mutual pick is the same unordered pair chosen from both ends.
        merged, merges = checkpoint_counted(
            best.groupBy(
                "lottery_id",
                F.greatest("src", "dst").alias("c"),
                F.least("src", "dst").alias("into"),
            )
            .agg(F.count("*").alias("_ends"))
            .where(F.col("_ends") == 2)
            .drop("_ends")
        )
        if not merges:
            break
        member = checkpoint_frame(relabel(member, merged, "c"))
        links = checkpoint_frame(
            relabel(relabel(links, merged, "src"), merged, "dst")
            .groupBy("lottery_id", "src", "dst")
            .agg(F.sum("weight").alias("weight"))
        )
    heads = member.groupBy("lottery_id", "c").agg(F.min("node").alias("_head"))
    rank = F.dense_rank().over(W.partitionBy("lottery_id").orderBy("_head")) - 1
    numbered = heads.select("lottery_id", "c", rank.cast("long").alias("community"))
    return member.join(numbered, ["lottery_id", "c"]).select("lottery_id", "node", "community")


def graph_values(pairs: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """All graph results as (lottery_id, metric_type, subject, value)."""
    paths = checkpoint_frame(path_counts(edges))

    def rows(df: DataFrame, metric: str, subject, value: str = "value") -> DataFrame:
        return df.select(
            "lottery_id",
            F.lit(metric).alias("metric_type"),
            subject.cast("string").alias("subject"),
            rounded(F.col(value).cast("double"), 6).alias("value"),
        )

    node = F.col("node")
    parts = [
        rows(pairs, "cooccurrence", F.concat_ws("-", "a", "b"), "weight"),
        rows(degree_centrality(edges), "degree", node),
        rows(closeness_centrality(paths), "closeness", node),
        rows(betweenness_centrality(edges, paths), "betweenness", node),
        rows(groups, "community", node, "community"),
        rows(density(edges), "density", F.lit("graph")),
        rows(modularity(edges, groups), "modularity", F.lit("graph")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def network_links(values: DataFrame) -> DataFrame:
    """Links parsed back from ``i-j`` subjects."""
    pair = F.split("subject", "-")
    return values.where(F.col("metric_type") == "cooccurrence").select(
        "lottery_id",
        pair[0].cast("int").alias("source"),
        pair[1].cast("int").alias("target"),
        F.col("value").alias("weight"),
    )


def network_view(values: DataFrame) -> DataFrame:
    """Nodes with degree and community; nodes without links are kept with degree 0."""
    links = network_links(values)
    ends = links.select("lottery_id", F.explode(F.array("source", "target")).alias("node"))
    degree = ends.groupBy("lottery_id", "node").agg(F.count("*").alias("degree"))
    groups = values.where(F.col("metric_type") == "community").select(
        "lottery_id",
        F.col("subject").cast("int").alias("node"),
        F.col("value").cast("long").alias("community"),
    )
    return degree.join(groups, ["lottery_id", "node"], "full").select(
        "lottery_id", "node", F.coalesce("degree", F.lit(0)).alias("degree"), "community"
    )
