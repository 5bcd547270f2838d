"""Lines, map matching, saved results."""

import math
import sqlite3

import pytest

from netloom.functions import geometry as Y
from netloom.operators import graph as G
from netloom.operators import map_matching as MM
from netloom.plans import network as P
from netloom.plans import places
from netloom.sources import derived as D
from netloom.sources import results as R


def test_lines():
    line = [(0.0, 0.0), (3.0, 4.0), (3.0, 10.0)]
    assert Y.from_wkb(Y.to_wkb(line)) == line and Y.from_wkb(Y.to_wkb(line[:1])) == line[:1]
    assert Y.length(line) == 11 and Y.point_at(line, 5) == (3, 4) and Y.locate(line, (5, 7)) == (8, 2)
    assert Y.substring(line, 2.5, 8) == [(1.5, 2.0), (3.0, 4.0), (3.0, 7.0)] and Y.substring(line, 8, 2.5)[0] == (3.0, 7.0)
    assert Y.join_lines([[(1, 1), (0, 0)], [(2, 2), (1, 1)], [(2, 2), (3, 3)]]) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert Y.with_ends([(0, 0), (5, 0)], (0, 1), (9, 0), 2) == [(0, 1), (5, 0), (9, 0)]
    assert Y.shape_between([(0, 0), (0, 50), (10, 50), (10, 0)], (0, 0), (10, 0)) == [(0, 0), (10, 0)]
    assert Y.shape_between([(0, 0), (5, 3), (10, 0)], (0, 0), (10, 0)) == [(0, 0), (5, 3), (10, 0)]


def test_ellipsoid():
    assert Y.geodesic((0, 0), (1, 0)) == pytest.approx(111319.4908, abs=1e-3)
    assert Y.geodesic((0, 0), (0, 1)) == pytest.approx(110574.3886, abs=1e-3)
    x, y, code = Y.utm(9.0, 0.0)
    assert (x, y, code) == (pytest.approx(500000), pytest.approx(0, abs=1e-6), 32632)
    x1, y1, _ = Y.utm(9.5, 48.0)
    x2, y2, _ = Y.utm(9.5005, 48.0)
    assert math.dist((x1, y1), (x2, y2)) == pytest.approx(Y.geodesic((9.5, 48.0), (9.5005, 48.0)), rel=1e-3)


def test_patterns_follow_roads(spark):
    roads = MM.collect_roads(spark, places._grid(spark))
    steps, reason, _ = MM.match_pattern(roads, [(10.0, 2.0), (250.0, -3.0), (499.0, 1.0)])
    assert not reason and [w for _, w in steps] == [1] * 5 and sum(Y.length(roads.lines[k]) for k, _ in steps) == 500
    assert MM.match_pattern(roads, [(10.0, 2.0), (2000.0, 0.0)])[1:] == ("unmatched-stop", 1)
    assert MM.match_pattern(roads, [(10.0, 2.0)])[1] == "too-few-stops"
    detour = [(0.0, 0.0), (0.0, 100.0), (500.0, 100.0), (500.0, 0.0)]
    by_shape, _, _ = MM.match_pattern(roads, [(0.0, 10.0), (500.0, 10.0)], detour)
    assert sum(Y.length(roads.lines[k]) for k, _ in by_shape) == 700
    at = {k: roads.ends[k] if w == 1 else roads.ends[k][::-1] for k, w in steps}
    assert all(at[a[0]][1] == at[b[0]][0] for a, b in zip(steps, steps[1:], strict=False))
    assert MM.clean_path([(1, 1), (1, 1), (2, 1), (2, -1), (3, 1)]) == [(1, 1), (3, 1)]


def test_spread_keeps_its_distance(spark):
    c = spark.createDataFrame([(1, k, float(40 * k), 0.0, float(k)) for k in range(10)], "zone long, node long, x double, y double, distance double")
    got = MM.spread(spark.createDataFrame([(1, 3)], "zone long, target int"), c).toPandas()
    assert got.node.tolist() == [0, 4, 8]


def test_saved_results(spark, sf, tmp_path):
    p = G.paths(spark, P.graph(spark, sf), P.pairs(spark, sf))
    R.save_paths(p, str(tmp_path / "paths"), 1, "car")
    one = p.where("origin = 3 and destination = 9").first().path
    assert R.path_of(spark, str(tmp_path / "paths"), 1, "car", 3, 9) == [(s.link_id, s.direction) for s in one]
    assert R.path_of(spark, str(tmp_path / "paths"), 1, "car", 3, 3) == []
    e = D.links(spark, sf)
    R.save_period(e, str(tmp_path / "g"), 1)
    R.save_period(e.where("link_id <= 5"), str(tmp_path / "g"), 2)
    R.save_period(e.where("link_id <= 3"), str(tmp_path / "g"), 2)
    assert R.read_period(spark, str(tmp_path / "g"), 2).count() == 3 and R.read_period(spark, str(tmp_path / "g"), 1).count() == e.count()
    assert R.load_report(R.dump_report({"rgap": math.inf, "n": [1, {"x": 2.5}]})) == {"rgap": math.inf, "n": [1, {"x": 2.5}]}
    con = sqlite3.connect(tmp_path / "x.sqlite")
    con.execute("create table t(a integer, b text)")
    con.execute("insert into t values (1, 'x'), (2, null)")
    con.commit()
    con.close()
    assert R.read_sqlite(spark, str(tmp_path / "x.sqlite"), "select * from t").count() == 2
    assert R.read_sqlite(spark, str(tmp_path / "x.sqlite"), "select * from t where a > 5").columns == ["a", "b"]
    assert R.skim_names(e.selectExpr("a_node origin", "b_node destination", "distance"), "final").columns == ["origin", "destination", "distance_final"]
    assert len(R.ranges(e, "distance")) == 6


def test_relational_search_agrees(spark, sf):
    from pyspark.sql import functions as F

    origins = D.zones(spark, sf).withColumnRenamed("zone", "origin").where("origin <= 4")
    one = G.min_plus(P.edges(spark, sf), origins, "distance")
    two = G.trees(spark, P.graph(spark, sf), origins)
    assert one.join(two.withColumnRenamed("cost", "c"), ["origin", "node"]).where(F.abs(F.col("cost") - F.col("c")) > 1e-9).isEmpty() and one.count() == two.count()


def test_stream_of_passages(spark, tmp_path):
    from netloom.streaming.counts import link_counts

    rows = spark.createDataFrame([("2024-01-01 00:01:00", 1, 1.0), ("2024-01-01 00:02:00", 1, 2.0), ("2024-01-01 00:07:00", 2, 1.0)], "t string, link long, pce double").selectExpr("to_timestamp(t) ts", "link", "pce")
    rows.write.parquet(str(tmp_path / "in"))
    stream = link_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("passages").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = {(r.link, r.n, r.volume) for r in spark.table("passages").collect()}
    finally:
        q.stop()
    assert got == {(1, 2, 3.0), (2, 1, 1.0)} == {(r.link, r.n, r.volume) for r in link_counts(rows).collect()}


def test_a_star_finds_the_shortest(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(9)
    at = {k: (9 + 0.01 * (k % 8) + 0.002 * rng.uniform(), 48 + 0.01 * (k // 8) + 0.002 * rng.uniform()) for k in range(1, 65)}
    rows = [(a, b) for a in at for b in (a + 1, a + 8) if b in at and (b != a + 1 or a % 8 != 7)]
    links = pd.DataFrame({"link_id": range(1, len(rows) + 1), "a_node": [a for a, _ in rows], "b_node": [b for _, b in rows], "direction": 0, "distance": [1.01 * Y.geodesic(at[a], at[b]) * rng.uniform(1, 1.3) for a, b in rows]})
    zones = spark.createDataFrame([(k,) for k in at], "zone long")
    g = G.arrays(G.directed(spark.createDataFrame(links)), zones, "distance")
    pairs = spark.createDataFrame([(a, b) for a in (1, 20, 37) for b in at], "origin long, destination long")
    cost = {(r.origin, r.destination): r.cost for r in G.skims(spark, g, zones, []).collect()}
    places_ = spark.createDataFrame([(k, *p) for k, p in at.items()], "node long, lon double, lat double")
    for kind in ("haversine", "equirectangular"):
        for r in G.a_star_paths(spark, g, pairs, places_, kind).collect():
            assert r.cost == pytest.approx(cost[r.origin, r.destination]) and (r.links is None) == (r.origin == r.destination)


def test_parameters(tmp_path):
    from netloom.parameters import Parameters

    Parameters().save(str(tmp_path / "p.json"))
    assert Parameters.load(str(tmp_path / "p.json")) == Parameters()
    (tmp_path / "q.json").write_text('{"assignment": {"gap": 0.01}}')
    assert Parameters.load(str(tmp_path / "q.json")).assignment == {"max_iterations": 250, "gap": 0.01, "steps_below": 1}
    (tmp_path / "q.json").write_text('{"assignment": {"colour": 1}}')
    with pytest.raises(ValueError):
        Parameters.load(str(tmp_path / "q.json"))
