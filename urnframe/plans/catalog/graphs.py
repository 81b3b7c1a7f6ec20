"""Catalog: co-occurrence graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from urnframe.functions.columns import rounded
from urnframe.operators import graph, lookup
from urnframe.plans.catalog.statistics import PAIRS, recent
from urnframe.plans.registry import job
from urnframe.session import checkpoint_frame

SPREAD = 1.0
HOPS = 16

EDGES = f"""{PAIRS},
edges AS (
  SELECT p.* FROM pairs p
  JOIN (SELECT lottery_id, avg(weight) + {SPREAD} * sqrt(avg(weight)) AS least FROM pairs GROUP BY 1) t
    ON t.lottery_id = p.lottery_id WHERE p.weight >= t.least),
links AS (
  SELECT lottery_id, a AS src, b AS dst, weight FROM edges
  UNION ALL SELECT lottery_id, b, a, weight FROM edges),
nodes AS (SELECT lottery_id, src AS node, count(*) AS degree FROM links GROUP BY 1, 2)"""


def _levels() -> str:
    parts = [
        "p0 AS MATERIALIZED (SELECT DISTINCT lottery_id, src AS s, src AS t, 0 AS d, 1.0::double AS c FROM links)",
        "v0 AS MATERIALIZED (SELECT * FROM p0)",
    ]
    for k in range(1, HOPS):
        parts.append(
            f"""p{k} AS MATERIALIZED (
  SELECT p.lottery_id, p.s, e.dst AS t, {k} AS d, sum(p.c) AS c
  FROM p{k - 1} p JOIN links e ON e.lottery_id = p.lottery_id AND e.src = p.t
  WHERE NOT EXISTS (SELECT 1 FROM v{k - 1} v WHERE v.lottery_id = p.lottery_id AND v.s = p.s AND v.t = e.dst)
  GROUP BY 1, 2, 3)"""
        )
        parts.append(f"v{k} AS MATERIALIZED (SELECT * FROM v{k - 1} UNION ALL SELECT * FROM p{k})")
    parts.append(f"paths AS (SELECT * FROM v{HOPS - 1})")
    return ",\n".join(parts)


PATHS = f"{EDGES},\n{_levels()}"


def edges(t):
    pairs = graph.cooccurrence(t.baskets)
    return graph.adjacency(pairs, graph.weight_threshold(pairs, SPREAD))


def decades(of):
    """Communities by decade, so that a partition can be checked in SQL."""
    return graph.graph_nodes(of).select(
        "lottery_id", "node", F.floor((F.col("node") - 1) / 10).alias("community")
    )


@job("cooccurrence", f"{PAIRS} SELECT * FROM pairs")
def _(t):
    return graph.cooccurrence(t.visible)


@job(
    "cooccurrence_window",
    f"""{recent(100)} SELECT r.lottery_id, x.number AS a, y.number AS b, count(*) AS weight
        FROM recent100 r JOIN members x ON x.draw_number = r.draw_number
        JOIN members y ON y.draw_number = r.draw_number AND x.number < y.number GROUP BY 1, 2, 3""",
)
def _(t):
    return graph.cooccurrence_window(t.baskets, 100)


@job(
    "cooccurrence_matrix",
    f"""{PAIRS} SELECT lottery_id, a AS src, b AS dst, weight FROM pairs
        UNION ALL SELECT lottery_id, b, a, weight FROM pairs""",
)
def _(t):
    return graph.cooccurrence_matrix(graph.cooccurrence(t.visible))


@job("adjacency", f"{EDGES} SELECT lottery_id, a, b, weight FROM edges")
def _(t):
    return edges(t)


@job("graph_nodes", f"{EDGES} SELECT * FROM nodes")
def _(t):
    return graph.graph_nodes(edges(t))


@job("graph_edges", f"{EDGES} SELECT lottery_id, a, b, weight FROM edges")
def _(t):
    return graph.graph_edges(graph.symmetric(edges(t)))


@job(
    "degree_centrality",
    f"""{EDGES} SELECT lottery_id, node,
          round(degree / (count(*) OVER (PARTITION BY lottery_id) - 1), 6) AS value FROM nodes""",
)
def _(t):
    return graph.degree_centrality(edges(t)).withColumn("value", rounded("value"))


@job("shortest_paths", f"{PATHS} SELECT lottery_id, s AS src, t AS dst, d AS dist FROM paths WHERE d > 0")
def _(t):
    return graph.shortest_paths(edges(t))


@job(
    "closeness_centrality",
    f"""{PATHS} SELECT lottery_id, s AS node,
          round((count(*) OVER (PARTITION BY lottery_id) - 1) / sum(d), 6) AS value
        FROM paths GROUP BY 1, 2""",
)
def _(t):
    out = graph.closeness_centrality(graph.path_counts(edges(t)))
    return out.withColumn("value", rounded("value"))


@job(
    "betweenness_centrality",
    f"""{PATHS}, through AS (
      SELECT a.lottery_id, a.t AS node, sum(a.c * b.c / w.c) AS value
      FROM paths a JOIN paths b ON b.lottery_id = a.lottery_id AND b.s = a.t
      JOIN paths w ON w.lottery_id = a.lottery_id AND w.s = a.s AND w.t = b.t AND w.d = a.d + b.d
      WHERE a.d > 0 AND b.d > 0 GROUP BY 1, 2)
    SELECT n.lottery_id, n.node, round(coalesce(t.value, 0), 6) AS value
    FROM nodes n LEFT JOIN through t ON t.lottery_id = n.lottery_id AND t.node = n.node""",
)
def _(t):
    links = checkpoint_frame(edges(t))
    out = graph.betweenness_centrality(links, graph.path_counts(links))
    return out.withColumn("value", rounded("value"))


@job("communities")
def _(t):
    return graph.communities(edges(t))


@job(
    "density",
    f"""{EDGES} SELECT lottery_id, round(sum(degree) / (count(*) * (count(*) - 1)), 6) AS value
        FROM nodes GROUP BY 1""",
)
def _(t):
    return graph.density(edges(t)).withColumn("value", rounded("value"))


@job(
    "modularity",
    f"""{EDGES}, sides AS (
      SELECT lottery_id, (src - 1) // 10 AS community, sum(weight) AS k,
             sum(CASE WHEN (src - 1) // 10 = (dst - 1) // 10 THEN weight ELSE 0 END) AS i
      FROM links GROUP BY 1, 2)
    SELECT lottery_id, round(sum(i / total - pow(k / total, 2)), 6) AS value
    FROM (SELECT *, sum(k) OVER (PARTITION BY lottery_id) AS total FROM sides) GROUP BY 1""",
)
def _(t):
    links = edges(t)
    return graph.modularity(links, decades(links)).withColumn("value", rounded("value"))


@job("graph_values")
def _(t):
    pairs = checkpoint_frame(graph.cooccurrence(t.baskets))
    links = graph.adjacency(pairs, graph.weight_threshold(pairs, SPREAD))
    return graph.graph_values(pairs, links, graph.communities(links))


@job(
    "read_graph_values",
    f"""{EDGES} SELECT lottery_id, 'degree' AS metric_type, cast(node AS varchar) AS subject,
          round(degree / (count(*) OVER (PARTITION BY lottery_id) - 1), 6) AS value FROM nodes""",
)
def _(t):
    links = edges(t)
    values = graph.degree_centrality(links).select(
        "lottery_id",
        F.lit("degree").alias("metric_type"),
        F.col("node").cast("string").alias("subject"),
        rounded("value").alias("value"),
    )
    return lookup.read_graph_values(values, "degree")


@job(
    "network_view",
    f"""{EDGES}, every AS (SELECT DISTINCT lottery_id, number AS node FROM numbers)
    SELECT e.lottery_id, e.node, coalesce(n.degree, 0) AS degree, (e.node - 1) // 10 AS community
    FROM every e LEFT JOIN nodes n ON n.lottery_id = e.lottery_id AND n.node = e.node""",
)
def _(t):
    links = edges(t).select(
        "lottery_id",
        F.lit("cooccurrence").alias("metric_type"),
        F.concat_ws("-", "a", "b").alias("subject"),
        F.col("weight").alias("value"),
    )
    seen = t.numbers.groupBy("lottery_id", "number").agg(F.lit(1).alias("_one"))
    groups = seen.select(
        "lottery_id",
        F.lit("community").alias("metric_type"),
        F.col("number").cast("string").alias("subject"),
        F.floor((F.col("number") - 1) / 10).alias("value"),
    )
    return graph.network_view(links.unionByName(groups))
