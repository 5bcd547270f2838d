"""Files: round trips and synthetic inputs."""

import json

import pandas as pd
import pytest

from netloom.operators import graph as G
from netloom.operators import network as N
from netloom.operators import route_choice as RC
from netloom.operators import transit as X
from netloom.sources import gtfs, matrices, networks
from netloom.sources.workspace import MIGRATIONS, Workspace


def od(spark):
    return spark.createDataFrame([(1, 2, 3.5, 0.0), (2, 1, float("nan"), 2.0), (3, 1, 0.0, 0.0)], "origin long, destination long, a double, b double")


def test_matrix_round_trips(spark, tmp_path):
    m = od(spark)
    matrices.write_matrix(m, str(tmp_path / "m.aem"))
    back = matrices.read_matrix(spark, str(tmp_path / "m.aem"), ["a", "b"])
    assert sorted(map(tuple, back.collect())) == [(1, 2, 3.5, 0.0), (2, 1, 0.0, 2.0)]
    matrices.write_matrix(m, str(tmp_path / "m.csv"), ["b"])
    assert [tuple(r) for r in matrices.read_matrix(spark, str(tmp_path / "m.csv")).collect()] == [(2, 1, 2.0)]
    matrices.write_matrix(m, str(tmp_path / "m"))
    assert matrices.read_matrix(spark, str(tmp_path / "m"), ["a"]).columns == ["origin", "destination", "a"]
    with pytest.raises(ImportError):
        matrices.read_matrix(spark, "x.omx")
    assert matrices.unique_names(["abcdef", "abcdeg"], 5) == ["abcde", "abc_1"]


FEED = {
    "agency": "agency_id,agency_name\n1,One\n",
    "routes": "﻿route_id,route_short_name,route_type\nR,Ré,3.0\n\n",
    "trips": "trip_id,route_id,service_id,direction_id\nT,R,S,0\nU,R,S,\nV,R,Q,0\n",
    "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nT,08:00:00,08:00:00,a,1\nT,08:10:00,08:11:00,b,2\nT,08:10:00,08:12:00,b,3\nT,08:12:00,08:12:00,c,4\nU,25:00:00,25:00:00,a,1\nU,,,b,2\nU,25:30:00,25:30:00,c,3\n",
    "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nS,1,1,1,1,1,0,0,20240101,20240131\nQ,0,0,0,0,0,1,1,20240101,20240131\n",
    "calendar_dates": "service_id,date,exception_type\nS,20240103,2\nS,20240106,1\n",
    "frequencies": "trip_id,start_time,end_time,headway_secs\nT,06:00:00,06:20:00,600\n",
    "stops": "stop_id,stop_name,stop_lat,stop_lon\na,A,1,2\nb,B,1,3\nc,C,1,4\n",
}


def test_feed(spark, tmp_path):
    for name, content in FEED.items():
        (tmp_path / f"{name}.txt").write_text(content)
    folder = str(tmp_path)
    assert [tuple(r) for r in gtfs.read_table(spark, folder, "routes").collect()] == [("R", "R", "", "", 3)]
    assert gtfs.read_table(spark, folder, "shapes").count() == 0
    days = {str(r.date) for r in gtfs.dates_of_services(spark, folder).where("service = 'S'").collect()}
    assert "2024-01-03" not in days and "2024-01-06" in days and len(days) == 23
    rows = gtfs.schedule_of(spark, folder, "2024-01-02").collect()
    trips = {r.trip for r in rows}
    assert trips == {"T-21600", "T-22200", "T-22800", "U"}
    first = sorted((r.seq, r.stop, r.arrival, r.departure) for r in rows if r.trip == "T-21600")
    assert [s[1] for s in first] == ["a", "b", "c"] and all(x[3] < y[2] for x, y in zip(first, first[1:], strict=False))
    assert gtfs.schedule_of(spark, folder, "2024-01-03").count() == 0
    stops = gtfs.read_table(spark, folder, "stops").selectExpr("stop_id stop", "stop_name name", "stop_lon x", "stop_lat y")
    gtfs.write_feed(gtfs.schedule_of(spark, folder, "2024-01-02"), stops, str(tmp_path / "out"))
    assert gtfs.read_table(spark, str(tmp_path / "out"), "stop_times").count() == len(rows)


def test_road_files(spark, tmp_path):
    (tmp_path / "link.csv").write_text("link_id,from_node_id,to_node_id,lanes,capacity\n1,1,2,1,100\n2,1,2,2,300\n3,2,1,1,50\n4,2,3,1,10\n")
    (tmp_path / "node.csv").write_text("node_id,x_coord,y_coord\n1,0,0\n2,1,0\n3,2,0\n")
    links, nodes = networks.read_gmns(spark, str(tmp_path / "link.csv"), str(tmp_path / "node.csv"))
    got = {r.link_id: r for r in links.collect()}
    assert got[1].direction == 0 and got[1].lanes_ab == 3 and got[1].capacity_ba == 50 and got[4].direction == 1 and nodes.count() == 3
    osm = {"elements": [{"type": "node", "id": k, "lat": 0.0, "lon": float(k)} for k in range(1, 6)] + [{"type": "way", "id": 10, "nodes": [1, 2, 3], "tags": {"highway": "primary_link", "lanes": "4"}}, {"type": "way", "id": 11, "nodes": [4, 2, 5], "tags": {"highway": "Trunk", "oneway": "yes", "lanes": "2"}}]}
    for k in range(2):
        (tmp_path / f"osm{k}.json").write_text(json.dumps(osm))
    segs, n = networks.read_osm(spark, str(tmp_path / "osm*.json"))
    rows = sorted((r.way, r.seg, tuple(r.nodes), r.link_type, r.lanes_ab, r.lanes_ba) for r in segs.collect())
    assert rows == [(10, 0, (1, 2), "primary", 2.0, 2.0), (10, 1, (2, 3), "primary", 2.0, 2.0), (11, 0, (4, 2), "trunk", 2.0, 0.0), (11, 1, (2, 5), "trunk", 2.0, 0.0)] and n.count() == 5
    layer = {"features": [{"properties": {"NO": "1", "FromNodeNo": "1", "ToNodeNo": "2", "TSysSet": "CAR, HGV;XX", "R_TSysSet": "", "Length": "1.2km", "V0PrT": "60km/h", "CapPrT": "1800veh/h"}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}}]}
    (tmp_path / "link.geojson").write_text(json.dumps(layer))
    r = networks.visum_links(networks.read_visum_layer(spark, str(tmp_path / "link.geojson"))).first()
    assert (r.direction, r.modes, r.distance, r.speed, r.capacity) == (1, "ch", 1200.0, 60.0, 1800.0) and abs(r.time - 1.2) < 1e-9


def test_workspace(spark, tmp_path):
    w = Workspace.create(spark, str(tmp_path / "w"))
    w.save("Flows", od(spark), "assignment", {"rgap": 0.1})
    with pytest.raises(ValueError):
        w.save("flows", od(spark))
    assert w.load("FLOWS").count() == 3 and w.results()[0]["exists"] and w.reconcile() == {"missing": [], "unregistered": []}
    other = w.clone("future")
    other.remove("Flows")
    assert w.scenarios() == ["future", "root"] and not other.results() and w.load("flows").count() == 3
    with pytest.raises(ValueError):
        w.drop_scenario("root")
    with pytest.raises(ValueError):
        w.set_period(1, 0, 10)
    ran = []
    MIGRATIONS.append((1, lambda ws: ran.append(ws.scenario)))
    try:
        assert w.upgrade() == [1] and w.upgrade() == [] and ran == ["root"]
    finally:
        MIGRATIONS.clear()


def test_validation(spark):
    with pytest.raises(ValueError, match="counterpart"):
        G.validate_links(spark.createDataFrame([(1, 1, 2, 0, 1.0)], "link_id long, a_node long, b_node long, direction int, t_ab double"))
    with pytest.raises(ValueError, match="unique"):
        G.validate_links(spark.createDataFrame([(1, 1, 2, 0), (1, 2, 3, 0)], "link_id long, a_node long, b_node long, direction int"))
    with pytest.raises(ValueError, match="direction"):
        G.validate_links(spark.createDataFrame([(1, 1, 2, 4)], "link_id long, a_node long, b_node long, direction int"))


def test_contraction_keeps_costs(spark):
    rng = pd.DataFrame({"link_id": range(1, 9), "a_node": [1, 2, 3, 4, 5, 2, 7, 8], "b_node": [2, 3, 4, 5, 6, 7, 8, 5], "direction": [0] * 8, "t": [1.0, 2, 3, 4, 5, 6, 7, 8]})
    links, zones = spark.createDataFrame(rng), spark.createDataFrame([(1,), (6,)], "zone long")
    chain = G.chains(links, zones)
    small = G.compressed(G.directed(links), chain, ("t",))
    one = G.arrays(G.directed(links), zones, "t")
    two = G.arrays(small.withColumnRenamed("chain", "link_id"), zones, "t")
    cost = lambda g: {(r.origin, r.destination): r.cost for r in G.skims(spark, g, zones, []).collect()}
    assert cost(one) == cost(two) and small.count() < 16


def test_upkeep(spark):
    lines = spark.createDataFrame([(1, 0.0, 0.0, 3.0, 4.0), (2, 3.0, 4.0, 9.0, 9.0)], "link_id long, x1 double, y1 double, x2 double, y2 double")
    links, nodes = N.attach_ends(lines, spark.createDataFrame([(7, 0.0, 0.0)], "node long, x double, y double"))
    assert sorted((r.link_id, r.a_node, r.b_node) for r in links.collect()) == [(1, 7, 8), (2, 8, 9)] and nodes.count() == 3
    left, moved = N.collapse(links, nodes, spark.createDataFrame([(1,)], "link_id long"))
    assert [(r.a_node, r.b_node) for r in left.collect()] == [(7, 9)] and (1.5, 2.0) in {(r.x, r.y) for r in moved.collect()}


def test_route_choice_checks(spark, sf):
    from netloom.plans import demand as Q

    p = Q.psl(spark, sf).where("mask").groupBy("origin", "destination").agg({"probability": "sum"}).toPandas()
    assert (p["sum(probability)"].round(9) == 1).all()
    with pytest.raises(KeyError):
        RC.load_routes(Q.psl(spark, sf).where("origin <> 1"), spark.createDataFrame([(1, 25, 5.0)], "origin long, destination long, trips double"), "trips")
    with pytest.raises(ValueError):
        RC.route_sets(spark, Q.graph(spark, sf), Q._all_pairs(spark, sf), "bfsle", colour=1)


def test_strategies_conserve_demand(spark, sf):
    from netloom.plans import transit as Q

    v, e = Q.full_graph(spark, sf)
    demand = Q._demand(spark, v)
    volume, skims = X.optimal_strategies(spark, e, demand, skims=["boardings"])
    into = volume.join(e.where("kind = 'egress_connector'"), "edge").agg({"volume": "sum"}).first()[0]
    assert abs(into - demand.agg({"trips": "sum"}).first()[0]) < 1e-6 and skims.where("time <= 0").count() == 0
