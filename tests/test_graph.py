"""Graph jobs against plain Python on small graphs."""

import itertools
from collections import deque

import pytest

from urnframe.operators import graph


@pytest.fixture(scope="module")
def edges(spark):
    pairs = [(1, 2, 5), (1, 3, 4), (2, 3, 6), (3, 4, 1), (4, 5, 5), (4, 6, 4), (5, 6, 7), (8, 9, 2)]
    return spark.createDataFrame([(1, *p) for p in pairs], "lottery_id int, a int, b int, weight bigint"), pairs


def neighbours(pairs):
    out = {}
    for a, b, _ in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def bfs(adj, s):
    dist, paths, queue = {s: 0}, {s: 1}, deque([s])
    while queue:
        v = queue.popleft()
        for w in adj[v]:
            if w not in dist:
                dist[w], paths[w] = dist[v] + 1, 0
                queue.append(w)
            if dist[w] == dist[v] + 1:
                paths[w] += paths[v]
    return dist, paths


def test_paths_closeness_betweenness(edges):
    df, pairs = edges
    adj = neighbours(pairs)
    every = {s: bfs(adj, s) for s in adj}
    paths = graph.path_counts(df)
    got = {(r.src, r.dst): (r.dist, r.paths) for r in paths.collect()}
    assert got == {(s, t): (d[t], p[t]) for s, (d, p) in every.items() for t in d}
    closeness = {r.node: r.value for r in graph.closeness_centrality(paths).collect()}
    for s, (d, _) in every.items():
        assert closeness[s] == pytest.approx((len(adj) - 1) / sum(d.values()))
    between = {r.node: r.value for r in graph.betweenness_centrality(df, paths).collect()}
    for v in adj:
        want = 0.0
        for s, t in itertools.permutations(adj, 2):
            if v in (s, t) or t not in every[s][0] or v not in every[s][0]:
                continue
            if every[s][0][v] + every[v][0][t] == every[s][0][t]:
                want += every[s][1][v] * every[v][1][t] / every[s][1][t]
        assert between[v] == pytest.approx(want)


def quality(pairs, of):
    m2 = 2 * sum(w for *_, w in pairs)
    total = 0.0
    for c in set(of.values()):
        inner = 2 * sum(w for a, b, w in pairs if of[a] == of[b] == c)
        k = sum(w for a, b, w in pairs for n in (a, b) if of[n] == c)
        total += inner / m2 - (k / m2) ** 2
    return total


def test_communities_find_the_triangles(edges):
    df, pairs = edges
    found = graph.communities(df)
    of = {r.node: r.community for r in found.collect()}
    assert of == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 8: 2, 9: 2}
    assert graph.modularity(df, found).first().value == pytest.approx(quality(pairs, of))


def test_density_and_degree(edges):
    df, pairs = edges
    adj = neighbours(pairs)
    v = len(adj)
    assert graph.density(df).first().value == pytest.approx(len(pairs) / (v * (v - 1) / 2))
    degree = {r.node: r.value for r in graph.degree_centrality(df).collect()}
    assert degree == pytest.approx({n: len(x) / (v - 1) for n, x in adj.items()})


def test_cooccurrence(baskets_of):
    got = graph.cooccurrence(baskets_of((1, [3, 1, 2]), (2, [2, 1])))
    assert {(r.a, r.b): r.weight for r in got.collect()} == {(1, 2): 2, (1, 3): 1, (2, 3): 1}
