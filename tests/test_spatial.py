"""Spatial searches that make near pairs only, against plain versions."""

import math

import pytest

from netloom.operators import spatial as P
from netloom.plans import registry
from tests.compare import connect, rows

registry.load_all()


def closest(stops, segments, bound, tie=0.001):
    out = {}
    for i, x, y in stops:
        found = []
        for _, x1, y1, x2, y2 in segments:
            dx, dy = x2 - x1, y2 - y1
            t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            found.append(math.hypot(x - (x1 + t * dx), y - (y1 + t * dy)))
        if x is not None and found and min(found) <= bound:
            out[i] = (round(min(found), 9), sum(d <= min(found) + tie for d in found))
    return out


def test_closest_links(spark):
    import random

    draw = random.Random(5)
    stops = [(k, draw.uniform(-300, 300), draw.gauss(0, 60)) for k in range(400)] + [(1000 + k, 7.0, 7.0) for k in range(3)] + [(2000, 5000.0, 0.0), (2001, 0.0, 30.0)]
    ends = [(draw.uniform(-300, 300), draw.uniform(-300, 300)) for _ in range(150)]
    segments = [(k, x, y, x + draw.uniform(-90, 90), y + draw.choice([0.0, draw.uniform(-90, 90)])) for k, (x, y) in enumerate(ends)]
    segments += [(500, 50.0, -80.0, 50.0, 200.0), (501, 50.0, -80.0, 50.0, 200.0), (502, 3.0, 3.0, 3.0, 3.0), (503, -1e6, 40.0, 1e3, 40.0), (504, 9e5, 9e5, 9e5, 9e5)]
    links = spark.createDataFrame(segments, "link_id long, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([*stops, (3000, None, None)], "id long, x double, y double")
    for bound in (100.0, 4.0, 20_000.0):
        got = {r.id: (round(r.distance, 9), r.n) for r in P.closest_links(points, links, bound).collect()}
        assert got == closest(stops, segments, bound)
    plain = P.classify_stops(P.stops_near_links(points, links.where("link_id <> 503"), 100.0), points)
    assert rows(P.status_of_stops(points, links.where("link_id <> 503")).toPandas().round(9)) == rows(plain.toPandas().round(9))
    for few in (points.limit(0), points.where("id = 3000")):
        assert P.closest_links(few, links, 100.0).isEmpty()
    assert P.closest_links(points, links.limit(0), 100.0).isEmpty()


@pytest.mark.parametrize("name", ["coverage_decision", "stop_status", "stop_status_counts", "max_connectors_per_zone"])
def test_far_pairs_are_not_made(spark, monkeypatch, name):
    """All pairs within the bound are a tenth of all pairs; the queries need the closest of them only."""
    sf = f"/root/testdata/sf{0.01 if name == 'max_connectors_per_zone' else 0.001}"
    radii, inner = [], P.within_radius
    monkeypatch.setattr(P, "stops_near_links", lambda *_: pytest.fail("all pairs within the bound are made"))
    monkeypatch.setattr(P, "within_radius", lambda a, b, r: radii.append(r) or inner(a, b, r))
    assert rows(registry.QUERIES[name](spark, sf).toPandas()) == rows(connect(sf).sql(registry.ORACLES[name]).fetchdf())
    assert not radii or radii[0] < 60.0
