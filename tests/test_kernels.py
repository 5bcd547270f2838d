"""Searches, strategies, volume-delay functions and equilibria against golden values, brute force and invariants."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.functions.delaunay import delaunay_edges
from netloom.functions.vdf import vdf
from netloom.operators import assignment as A
from netloom.operators import graph as G
from netloom.operators import kernels as K
from netloom.plans import network as P
from netloom.sources import derived as D

FLOWS = np.arange(0, 2.01, 0.2)
# Published results of the functions at free-flow time 1 and capacity 1.
GOLDEN = {
    ("akcelik", 0.25, 8.0): [1, 1.17416574, 1.32169906, 1.45677644, 1.58442888, 1.70710678, 1.82620873, 1.94261498, 2.05691786, 2.16953597, 2.28077641],
    ("conical", 9.0, 1.06): [1, 1.017609498, 1.043053698, 1.092812279, 1.228923167, 2, 4.828923168, 8.292812282, 11.8430537, 15.4176095, 19.00220725],
    ("inrets", 0.95): [1, 1.011111111, 1.028571429, 1.06, 1.133333333, 1.5, 2.16, 2.94, 3.84, 4.86, 6],
}


@pytest.mark.parametrize("key", GOLDEN)
def test_vdf_values(key):
    name, *p = key
    got = vdf(name).values(FLOWS, np.ones(11), np.ones(11), *p)
    assert np.allclose(got, GOLDEN[key], atol=1e-6)


@pytest.mark.parametrize("key", [*GOLDEN, ("bpr", 0.15, 4.0), ("bpr2", 0.15, 4.0)])
def test_vdf_slopes(key):
    name, *p = key
    x, h = np.array([0.3, 0.7, 1.3, 1.9]), 1e-6
    f = vdf(name)
    one = np.ones(4)
    assert np.allclose(f.slopes(x, one, one, *p), (f.values(x + h, one, one, *p) - f.values(x - h, one, one, *p)) / (2 * h), rtol=1e-4)
    assert f.slopes(np.zeros(1), one[:1], 3 * one[:1], *p)[0] == 3


def test_vdf_bounds():
    with pytest.raises(ValueError):
        vdf("bpr").check(0.15, 0.5)
    with pytest.raises(ValueError):
        vdf("none")


def triangle():
    """Six nodes, all zones, six one-way links."""
    links = [(1, 1, 3), (2, 3, 2), (3, 2, 1), (4, 4, 1), (5, 2, 5), (6, 6, 2)]
    t = np.array([a - 1 for _, a, _ in links]), np.array([b - 1 for _, _, b in links])
    return K.GraphArrays(np.arange(1, 7), *t, np.ones(6), np.array([k for k, *_ in links]), np.ones(6, dtype=int), frozenset({0, 1, 3, 4, 5}))


def test_blocked_centroids():
    g = triangle()
    nodes = lambda o, d, blocked: [int(g.nodes[g.head[k]]) for k in K.path_edges(g, K.shortest_tree(g, o - 1, blocked), d - 1)]
    assert nodes(1, 2, True) == [3, 2]
    assert nodes(4, 5, False) == [1, 3, 2, 5]
    assert nodes(4, 5, True) == []
    assert nodes(2, 1, True) == [1]


def random_graph(rng, n=30, m=120):
    tail, head = rng.integers(0, n, m), rng.integers(0, n, m)
    return K.GraphArrays(np.arange(n) + 1, tail, head, rng.uniform(1, 10, m), np.arange(m), np.ones(m, dtype=int), frozenset(range(5)), {"w": rng.uniform(0, 1, m)})


def test_searches_agree():
    rng = np.random.default_rng(0)
    for _ in range(20):
        g = random_graph(rng)
        n = len(g.nodes)
        dist = np.full((n, n), np.inf)
        np.fill_diagonal(dist, 0)
        for t, h, c in zip(g.tail, g.head, g.cost, strict=True):
            dist[t, h] = min(dist[t, h], c)
        for k in range(n):
            dist = np.minimum(dist, dist[:, [k]] + dist[[k], :])
        tree = K.shortest_tree(g, 0)
        assert np.allclose(tree.cost, dist[0])
        for v in range(1, n):
            path = K.path_edges(g, tree, v)
            assert bool(path) == np.isfinite(dist[0, v])
            if path:
                assert math.isclose(g.cost[path].sum(), dist[0, v])
                assert math.isclose(K.skim(g, tree, ["w"])[v, 0], g.fields["w"][path].sum(), abs_tol=1e-9)
                assert math.isclose(K.a_star(g, 0, v, np.zeros(n)).cost[v], dist[0, v])
                assert math.isclose(K.shortest_tree(g, 0, wanted={v}).cost[v], dist[0, v])
        assert (K.reachable(g, 0) == np.isfinite(dist[0])).all()
        flows, brute = np.zeros((len(g.tail), 1)), np.zeros(len(g.tail))
        demand = {v: np.array([float(v)]) for v in range(n)}
        K.load(g, tree, demand, flows)
        for v in range(1, n):
            brute[K.path_edges(g, tree, v)] += v
        assert np.allclose(flows[:, 0], brute)


def test_route_sets_are_simple_and_distinct():
    g = random_graph(np.random.default_rng(3))
    for method, more in (("bfsle", {"max_routes": 6, "max_depth": 4}), ("lp", {"max_routes": 4, "penalty": 1.3})):
        found = K.route_set(g, 0, 7, method, **more)
        assert 1 <= len(found) <= 6 and len({tuple(r) for r in found}) == len(found)
        for r in found:
            assert g.tail[r[0]] == 0 and g.head[r[-1]] == 7 and all(g.head[a] == g.tail[b] for a, b in itertools.pairwise(r))
        assert found[0] == K.path_edges(g, K.shortest_tree(g, 0), 7)


def test_strategy_of_the_classic_example():
    """The four-line example of Spiess and Florian: 27.75 minutes, half of the demand boards each line at the origin."""
    minute, inf = 60.0, math.inf
    edges = []

    def line(stops, times, headway, base):
        for k, (a, b) in enumerate(itertools.pairwise(stops)):
            on, off = base + 2 * k, base + 2 * k + 1
            edges.append((a, on, 0.0, 2 / (headway * minute)))
            edges.append((on, off, times[k] * minute, inf))
            edges.append((off, b, 0.0, inf))
            if k:
                edges.append((off - 2, on, 0.0, inf))

    line([0, 3], [25], 12, 10)  # A to B
    line([0, 1, 2], [7, 6], 12, 20)  # A to X to Y
    line([1, 2, 3], [4, 4], 30, 30)  # X to Y to B
    line([2, 3], [10], 6, 40)  # Y to B
    used = sorted({x for e in edges for x in e[:2]})
    at = {v: k for k, v in enumerate(used)}
    tail, head = np.array([at[e[0]] for e in edges]), np.array([at[e[1]] for e in edges])
    time, freq = np.array([e[2] for e in edges]), np.array([e[3] for e in edges])
    u, f, chosen, key, _ = K.hyperpath(tail, head, time, freq, len(used), at[3])
    assert math.isclose(u[at[0]], 1665, rel_tol=1e-6)
    volume, flows = np.zeros(len(used)), np.zeros(len(edges))
    volume[at[0]] = 1
    K.assign_strategy(tail, head, freq, f, chosen, key, volume, flows)
    assert math.isclose(volume[at[3]], 1, rel_tol=1e-9)
    boards = {(e[0], e[1]): v for e, v in zip(edges, flows, strict=True)}
    assert math.isclose(boards[0, 10], 0.5, rel_tol=1e-6) and math.isclose(boards[0, 20], 0.5, rel_tol=1e-6)


def test_loading_balances(spark, sf):
    g, od = P.graph(spark, sf), D.demand(spark, sf)
    flows = A.all_or_nothing(spark, g, od, ["trips"])
    spent = flows.join(P.edges(spark, sf), ["link_id", "direction"]).agg(F.sum(F.col("trips") * F.col("distance"))).first()[0]
    cost = G.skims(spark, g, D.zones(spark, sf), [])
    due = od.join(cost, ["origin", "destination"]).where("origin <> destination").agg(F.sum(F.col("trips") * F.col("cost"))).first()[0]
    assert math.isclose(spent, due, rel_tol=1e-9)


def test_equilibria_improve(spark, sf):
    gaps = {}
    for how in ("msa", "fw", "bfw"):
        found = P.equilibrium(spark, sf, how, max_iterations=25, gap=1e-4)
        gaps[how] = found.report[-1]["rgap"]
        assert found.report[1]["rgap"] >= gaps[how]
    assert gaps["fw"] < 1e-2 and gaps["bfw"] < 1e-2 and gaps["bfw"] <= gaps["msa"]


def test_relative_gap_algebra():
    t, f, x, y = np.array([2.0, 3]), np.array([0.5, 1.5]), np.array([8.0, 2]), np.array([10.0, 1])
    assert ((t + f) * x).sum() == 29 and ((t + f) * y).sum() == 29.5


def test_bounded_minimum():
    assert abs(A.bounded_minimum(lambda a: (a - 0.37) ** 2, 0, 1, 1e-6, 60) - 0.37) < 1e-5
    assert A.root(lambda a: a - 0.25, 0, 1, 1e-9) == pytest.approx(0.25, abs=1e-8)
    assert A.root(lambda a: a + 1, 0, 1, 1e-9) is None


def test_delaunay_is_empty_of_points():
    rng = np.random.default_rng(5)
    points = [tuple(p) for p in rng.uniform(0, 10, (25, 2))]
    edges = set(delaunay_edges(points))
    brute = set()
    for i, j, k in itertools.combinations(range(25), 3):
        (ax, ay), (bx, by), (cx, cy) = points[i], points[j], points[k]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        ux = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
        uy = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
        r = (ax - ux) ** 2 + (ay - uy) ** 2
        if all((x - ux) ** 2 + (y - uy) ** 2 >= r * (1 - 1e-9) for m, (x, y) in enumerate(points) if m not in (i, j, k)):
            brute |= {(i, j), (j, k), (i, k)}
    assert edges == brute
