"""The graph object, contracted loading, edits of networks, results that are kept, procedures and logs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom import running
from netloom.operators import assignment as A
from netloom.operators import distribution as DS
from netloom.operators import graph as G
from netloom.operators import kernels as K
from netloom.operators import outcomes as O
from netloom.operators import spatial as P
from netloom.operators import upkeep as U
from netloom.operators.model import RoadGraph, check_zones
from netloom.plans import network as Q
from netloom.plans import upkeep as Y
from netloom.sources import derived as D
from netloom.sources import networks as S
from netloom.sources.workspace import Workspace


def grid(rng, side, zones, cost="real"):
    n = np.arange(side * side).reshape(side, side)
    ends = np.concatenate([np.stack([n[:, :-1].ravel(), n[:, 1:].ravel()], 1), np.stack([n[:-1].ravel(), n[1:].ravel()], 1)])
    c = rng.uniform(1, 3, 2 * len(ends))
    c = np.round(c) if cost == "ties" else np.where(rng.random(len(c)) < 0.2, 0.0, np.round(c)) if cost == "instant" else c
    ways = np.repeat([1, -1], len(ends))
    return K.GraphArrays(np.arange(side * side), np.r_[ends[:, 0], ends[:, 1]], np.r_[ends[:, 1], ends[:, 0]], c, np.r_[np.arange(len(ends)), np.arange(len(ends))], ways, frozenset(rng.choice(side * side, zones, replace=False).tolist()), {"f": rng.uniform(0, 5, len(c))})


@pytest.mark.parametrize("cost", ["real", "ties", "instant"])
@pytest.mark.parametrize("blocked", [False, True])
def test_searches_together_as_one_by_one(cost, blocked):
    rng = np.random.default_rng(3)
    g = grid(rng, 9, 12, cost)
    origins = rng.choice(81, 30, replace=False)
    trees = K.shortest_trees(g, origins, blocked)
    alone = [K.shortest_tree(g, int(o), blocked) for o in origins]
    assert all((t.cost == trees.cost[k]).all() and (t.edge == trees.edge[k]).all() for k, t in enumerate(alone))
    assert all(np.allclose(K.path_sums(g, trees, ["f"])[k], K.skim(g, trees.tree(k), ["f"])) for k in range(30))
    rows, targets, demand = np.repeat(np.arange(30), 20), rng.integers(0, 81, 600), rng.uniform(0, 1, (600, 2))
    together, one = np.zeros((len(g.tail), 2)), np.zeros((len(g.tail), 2))
    K.load_trees(g, trees, rows, targets, demand, together)
    for k, t in enumerate(alone):
        want = {}
        for v, x in zip(targets[rows == k].tolist(), demand[rows == k], strict=True):
            want[v] = want.get(v, 0) + x
        K.load(g, t, want, one)
    assert np.allclose(together, one)


def test_long_paths_settle(spark):
    """Chains of more links than any fixed count of rounds."""
    line = spark.range(90).selectExpr("id + 1 link_id", "1 direction", "id tail", "id + 1 head", "1.5D cost")
    got = G.min_plus(line, spark.createDataFrame([(0,)], "origin long"), "cost").agg(F.max("cost").alias("m"), F.count("*").alias("n")).first()
    assert (got.m, got.n) == (135.0, 91)
    both = line.unionByName(line.selectExpr("link_id", "-1 direction", "head tail", "tail head", "cost"))
    assert G.dead_ends(both, spark.createDataFrame([(0,), (3,)], "zone long")).select("link_id").distinct().count() == 87


def test_graph_object(spark, sf, tmp_path):
    g = Y.road_graph(spark, sf)
    assert g.summary()["contracted"] == Q.edges(spark, sf).count() and set(g.available_skims()) == {"capacity", "distance", "free_flow_time"}
    with pytest.raises(ValueError):
        g.with_cost("colour")
    with pytest.raises(ValueError):
        RoadGraph.build(D.links(spark, sf), D.zones(spark, sf)).with_blocked()
    with pytest.raises(ValueError):
        RoadGraph.build(D.links(spark, sf), D.zones(spark, sf)).skims()
    for bad in ([(0,)], [(1,), (1,)], [(None,)]):
        with pytest.raises(ValueError):
            check_zones(spark.createDataFrame(bad, "zone long"))
    with pytest.raises(ValueError):
        check_zones(spark.createDataFrame([("a",)], "zone string"))
    small = g.without([3, 4, 5])
    assert small.edges.where("link_id in (3, 4, 5)").count() == 0 and g.edges.where("link_id = 3").count() > 0
    small.with_skims("distance").save(str(tmp_path / "graph"))
    back = RoadGraph.read(spark, str(tmp_path / "graph"))
    assert (back.cost, back.skimmed, back.excluded, back.contract) == ("distance", ("distance",), (3, 4, 5), True)
    whole = RoadGraph.build(Y.pieces(spark, sf), D.zones(spark, sf), contract=False).with_cost("distance").load(D.demand(spark, sf), ["trips"])
    one, two = ({(r.link_id, r.direction): r.trips for r in x.collect()} for x in (whole, g.load(D.demand(spark, sf), ["trips"])))
    assert one.keys() == two.keys() and all(math.isclose(one[k], two[k], rel_tol=1e-9) for k in one)


def test_kept_results(spark, sf, tmp_path):
    found = Q.equilibrium(spark, sf, "bfw", max_iterations=5, gap=1e-3)
    w = Workspace.create(spark, str(tmp_path / "work"))
    O.save_results(w, "Base", found)
    O.save_results(w, "used", found, keep_zero=False)
    with pytest.raises(ValueError):
        O.save_results(w, "base", found)
    kept = w.load("base")
    assert {"link_id", "car_ab", "car_tot", "VOC_max", "Congested_Time_AB", "PCE_tot", "Preload_tot"} <= set(kept.columns)
    assert kept.where("abs(PCE_tot - car_tot) > 1e-9").count() == 0 and w.load("used").where("PCE_tot <= 0").count() == 0
    od, flows = A.select_link(spark, Q.graph(spark, sf), D.demand(spark, sf), ["trips"], Q._SETS)
    O.save_select_link(w, "sl", od, flows, ["trips"])
    assert w.load("sl_matrices").columns == ["origin", "destination", "east_trips", "west_trips"] and w.load("sl_flows").count()
    O.save_transit_results(w, "pt", {"a": spark.createDataFrame([(1, 2.0), (2, 0.0)], "edge long, volume double"), "b": spark.createDataFrame([(3, 1.0)], "edge long, volume double")}, keep_zero=False)
    assert {(r.edge, r.a_volume, r.b_volume) for r in w.load("pt").collect()} == {(1, 2.0, 0.0), (3, 0.0, 1.0)}
    with pytest.raises(ValueError):
        O.all_skims(od, None, "all")
    with pytest.raises(ValueError):
        A.merged_preload(Q.edges(spark, sf), spark.createDataFrame([(1, 1, 2.0), (1, 1, 3.0)], "link_id long, direction int, preload double"))


def test_edits_keep_the_rules(spark):
    links = spark.createDataFrame([(1, 1, 2, "c", "road"), (2, 2, 3, "cw", "path"), (3, 3, 4, "w", "centroid_connector")], "link_id long, a_node long, b_node long, modes string, link_type string")
    nodes = spark.createDataFrame([(1, True, 0.0, 0.0), (2, False, 1.0, 0.0), (3, False, 2.0, 0.0), (4, False, 3.0, 0.0)], "node long, is_centroid boolean, x double, y double")
    ids = lambda *x: spark.createDataFrame([(k,) for k in x], "link_id long")
    left, kept = U.delete_links(links, nodes, ids(1, 3))
    assert {r.link_id for r in left.collect()} == {2} and {r.node for r in kept.collect()} == {1, 2, 3}
    new = lambda *x: spark.createDataFrame(list(x), "node long, to long")
    moved, changed = U.renumber_nodes(nodes, links, new((2, 3), (3, 2)))
    assert {(r.link_id, r.a_node, r.b_node) for r in changed.collect()} == {(1, 1, 3), (2, 3, 2), (3, 2, 4)} and moved.count() == 4
    modes, types = spark.createDataFrame([("c",), ("w",)], "mode string"), spark.createDataFrame([("road",), ("path",), ("centroid_connector",), ("old",)], "link_type string")
    assert U.delete_link_type(types, links, "old").count() == 3
    assert U.set_modes(links, modes, spark.createDataFrame([(1, "w")], "link_id long, modes string")).where("link_id = 1").first().modes == "w"
    table, fields = U.add_field(links, spark.createDataFrame([("a", "b")], "name string, description string"), "toll_ab", description="money")
    assert dict(table.dtypes)["toll_ab"] == "double" and fields.count() == 2
    assert U.add_centroids(nodes, spark.createDataFrame([(9, 5.0, 5.0)], "zone long, x double, y double")).where("node = 9").first().is_centroid
    assert {(r.node, r.modes) for r in U.refreshed_nodes(nodes, links).collect()} == {(1, "c"), (2, "cw"), (3, "cw"), (4, "w")}
    for wrong in (
        lambda: U.delete_links(links, nodes, ids(7)), lambda: U.copy_links(links, ids(7)), lambda: U.renumber_nodes(nodes, links, new((2, 3))), lambda: U.renumber_nodes(nodes, links, new((2, 8), (3, 8))),
        lambda: U.delete_modes(modes, links, ["c"]), lambda: U.delete_link_type(types, links, "road"), lambda: U.delete_link_type(types, links, "centroid_connector"), lambda: U.add_field(links, fields, "modes"),
        lambda: U.add_field(links, fields, "1st"), lambda: U.add_centroids(nodes, spark.createDataFrame([(2, 5.0, 5.0)], "zone long, x double, y double")),
        lambda: U.set_modes(links, modes, spark.createDataFrame([(1, "z")], "link_id long, modes string")), lambda: U.move_nodes(nodes, links, spark.createDataFrame([(2, 0.0, 0.0)], "node long, x double, y double")),
    ):
        with pytest.raises(ValueError):
            wrong()


def test_area_grid_covers_the_area():
    ring = [(math.cos(t) * (3 + math.sin(5 * t)), math.sin(t) * (3 + math.sin(5 * t))) for t in np.linspace(0, 2 * math.pi, 201)]
    ring[-1] = ring[0]
    area = lambda r: abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:], strict=False))) / 2
    tiles = P.area_grid(ring)
    assert len(tiles) == 9 and math.isclose(sum(map(area, tiles)), area(ring), rel_tol=1e-9)
    assert P.clip([(0, 0), (1, 0), (1, 1), (0, 0)], (5, 5, 6, 6)) == []


def test_fitting_in_place_as_in_one_task(spark, sf, monkeypatch):
    seed, v = D.demand(spark, sf).withColumnRenamed("trips", "value"), __import__("netloom.plans.demand", fromlist=["x"]).vectors(spark, sf)
    one = DS.ipf(seed, v, tolerance=1e-9)
    monkeypatch.setattr(DS, "CELLS_IN_TASK", 10)
    two = DS.ipf(seed, v, tolerance=1e-9)
    a, b = ({(r.origin, r.destination): r.value for r in x.matrix.collect()} for x in (one, two))
    assert one.iterations == two.iterations and math.isclose(one.error, two.error, rel_tol=1e-3, abs_tol=1e-12) and a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)


def test_rows_are_numbered_across_ranges(spark):
    df = spark.range(5000).selectExpr("id * 7919 % 5003 k", "id")
    got = G.numbered(df.repartition(7), ["k"], "n", 10).orderBy("k").collect()
    assert [r.n for r in got] == list(range(10, 5010)) and G.numbered(df.limit(0), ["k"], "n").count() == 0


def test_letters_of_types(spark):
    got = {r.name: r.letter for r in S.letters(spark.createDataFrame([("road",), ("rail",), ("ring",), ("r",)], "name string")).collect()}
    assert got == {"r": "r", "rail": "a", "ring": "i", "road": "o"}
    with pytest.raises(ValueError):
        S.letters(spark.range(60).selectExpr("concat('t', id) name"))


def test_procedures_progress_and_log(tmp_path):
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "__init__.py").write_text("def double(x=1):\n    return 2 * x\n\ndef _hidden():\n    pass\n")
    (tmp_path / "parameters.json").write_text('{"double": {"x": 21}}')
    found = running.procedures(str(tmp_path), str(tmp_path / "parameters.json"))
    assert set(found) == {"double"} and found["double"]() == 42
    (tmp_path / "parameters.json").write_text('{"triple": {}}')
    with pytest.raises(ValueError):
        running.procedures(str(tmp_path), str(tmp_path / "parameters.json"))
    log, seen = running.Log(str(tmp_path / "project.log")), []
    progress = running.Progress([seen.append, log])
    assert list(progress.over([1, 2], "items")) == [1, 2]
    assert [e["what"] for e in seen] == ["start", "step", "step", "end"] and len(log.contents()) == 4
    log.clear()
    assert log.contents() == []


def test_whole_feeds_round_trip(spark, tmp_path):
    import csv
    import io
    import zipfile

    from netloom.sources import system as T

    rows = [("bus|0", "t1", 0, 1, 30, 40), ("bus|0", "t1", 1, 2, 90_000, 90_010), ("bus|0", "t2", 0, 1, 60, 70), ("bus|0", "t2", 1, 2, 99, 100), ("tram|1", "t3", 0, 2, 5, 6), ("tram|1", "t3", 1, 1, 50, 60)]
    schedule = spark.createDataFrame(rows, "pattern string, trip string, seq int, stop long, arrival int, departure int")
    stops = spark.createDataFrame([(1, 0.0, 1.0, "A"), (2, 2.0, 3.0, "B")], "stop long, x double, y double, name string")
    system = T.system_of(schedule, stops)
    assert {(r.pattern_id, r.route_id, r.n_trips) for r in system["patterns"].collect()} == {(1, 1, 2), (2, 2, 1)}
    T.write_whole_feed(system, str(tmp_path / "feed"))
    T.zip_feed(str(tmp_path / "feed"), str(tmp_path / "feed.zip"))
    with zipfile.ZipFile(tmp_path / "feed.zip") as z:
        assert set(z.namelist()) == {f"{n}.txt" for n in ("agency", "calendar", "stops", "routes", "trips", "stop_times", "shapes")}
        times = list(csv.DictReader(io.StringIO(z.read("stop_times.txt").decode())))
    assert len(times) == 6 and {r["arrival_time"] for r in times} >= {"25:00:00", "00:00:30"}


def test_visum_zones_and_connectors(spark, tmp_path):
    import json

    def layer(name, features):
        path = tmp_path / f"{name}.geojson"
        path.write_text(json.dumps({"features": [{"properties": p, "geometry": g} for p, g in features]}))
        return S.read_visum_layer(spark, str(path))

    point = {"type": "Point", "coordinates": [1.5, 2.5]}
    assert [tuple(r) for r in S.visum_zones(layer("z", [({"no": "7", "Name": "x"}, point)])).collect()] == [(7, 1.5, 2.5, "x")]
    both = [({"ZONENO": "7", "NODENO": "1", "DIRECTION": w, "TSYSSET": "CAR,BIKE", "LENGTH": "0.5km"}, point) for w in ("O", "D")]
    one = [({"ZONENO": "7", "NODENO": "2", "DIRECTION": "D", "TSYSSET": "CAR", "LENGTH": "300m"}, point), ({"ZONENO": "7", "NODENO": "3", "DIRECTION": "O", "TSYSSET": "BOAT", "LENGTH": "1km"}, point)]
    got = {r.node: (r.direction, r.modes, r.distance, r.speed) for r in S.visum_connectors(layer("c", both + one)).collect()}
    assert got == {1: (0, "bc", 500.0, S.CONNECTOR_SPEED), 2: (-1, "c", 300.0, S.CONNECTOR_SPEED)}
