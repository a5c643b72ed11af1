"""Rings, parts, crossings, repair, scan lines and unions on hand-made polygons."""

import random

import pytest
from pyspark.sql import functions as F

from orefield.operators import polygons as Y
from orefield.operators import raster as A
from orefield.operators import spatial as P

SCHEMA = "k string, part int, ring int, seq int, x double, y double"


def table(spark, shapes):
    """shapes: {key: [[ring, ring, ...] of each part]}."""
    rows = [(k, p, r, s, float(x), float(y)) for k, parts in shapes.items() for p, rings in enumerate(parts) for r, points in enumerate(rings) for s, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, SCHEMA)


def square(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


HOLED = {"a": [[square(0, 0, 6, 8), square(2, 2, 4, 4)], [square(6.5, 2, 8, 4)]]}


def points(spark, at):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "id int, lon double, lat double")


def hit(spark, at, edge_table, key, **options):
    return sorted((r.id, r[key]) for r in P.containing(points(spark, at), edge_table, ["id"], key, **options).collect())


def test_holes_and_second_parts(spark):
    at = [(1, 1), (5, 7), (7, 3), (3, 3), (6.2, 3), (2, 3)]
    joined = P.point_in_polygon_join(points(spark, at), table(spark, HOLED), ["id"], "k").collect()
    assert {r.id: r.k for r in joined} == {0: "a", 1: "a", 2: "a", 3: None, 4: None, 5: None}
    assert hit(spark, at, Y.edges(table(spark, HOLED), "k"), "k", boundary="covers")[-1] == (5, "a")


def test_overlapping_parts_hold_their_overlap(spark):
    shapes = {"a": [[square(0, 0, 4, 4)], [square(2, 0, 6, 4)]]}
    assert hit(spark, [(3, 2), (1, 1), (5, 1), (7, 1)], Y.edges(table(spark, shapes), "k"), "k") == [(0, "a"), (1, "a"), (2, "a")]


def test_metrics_subtract_holes_and_add_parts(spark):
    near_equator = {"a": [[square(0, 0, 0.06, 0.08), square(0.02, 0.02, 0.04, 0.04)], [square(0.07, 0.02, 0.08, 0.04)]]}
    m = Y.polygon_metrics(table(spark, near_equator), "k").first()
    hectares = (6371.0088 * 3.141592653589793 / 180 / 100) ** 2 * 100
    assert abs(m.area_ha / hectares - (48 - 4 + 2)) < 1e-3 and (m.n_parts, m.n_vertices, m.simple) == (2, 12, True)
    assert abs(m.centroid_x - (48 * 0.03 - 4 * 0.03 + 2 * 0.075) / 46) < 1e-9


def test_repair_of_rings(spark):
    shapes = {
        "plain": [[square(0, 0, 1, 1)]],
        "bow": [[[(0, 0), (1, 1), (1, 0), (0, 1)]]],
        "inner": [[[(0, 0), (2, 2), (2, 0), (0, 2), (1.2, 1)]]],
        "line": [[[(0, 0), (1, 1), (2, 2)]]],
        "parts": [[square(0, 0, 1, 1)], [[(3, 0), (4, 1), (4, 0), (3, 1)]]],
        "concave": [[[(0, 0), (4, 0), (4, 4), (2, 1)]]],
    }
    mended, status = Y.repaired(table(spark, shapes), "k")
    assert {r.k: (r.valid, r.reordered) for r in status.collect()} == {"plain": (True, False), "bow": (True, True), "inner": (False, False), "line": (False, False), "parts": (True, True), "concave": (True, False)}
    areas = {r.k: r for r in Y.polygon_metrics(mended, "k").collect()}
    assert set(areas) == {"plain", "bow", "parts", "concave"} and all(r.simple for r in areas.values())
    assert abs(areas["bow"].area_ha / areas["plain"].area_ha - 1) < 1e-9


def test_a_long_ring_meets_in_squares(spark):
    """A comb of 20,000 corners: its pairs of neighbouring edges are few, and one crossing is found."""
    n = 5_000
    ring = [p for i in range(n) for p in ((2 * i, 0), (2 * i, 10), (2 * i + 1, 10), (2 * i + 1, 0))]
    ring += [(2 * n, 0), (2 * n, -1), (0, -1)]
    crossed = ring[:10_000] + [(ring[10_000][0], 12)] + ring[10_001:]
    crossed[10_003] = (crossed[10_003][0] + 3, 5)
    t = table(spark, {"comb": [[ring]], "crossed": [[crossed]]})
    assert [r.k for r in Y.crossing_parts(Y.edges(t, "k"), "k").collect()] == ["crossed"]
    assert Y.edge_pairs(Y.edges(t, "k"), ["k", "part"], ["ring", "seq"]).count() < 40 * len(ring)


def test_scan_lines_equal_points_at_pixel_centres(spark):
    rng = random.Random(4)
    shapes = {f"p{i}": [[[(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(7)]], [square(2, 2, 5, 5), square(3, 3, 4, 4)]] for i in range(4)}
    grid = A.Grid(-1.0, 11.0, 0.5)
    t = table(spark, shapes)
    runs = A.rasterize(t, "k", grid).select("k", "row", F.explode(F.sequence("first", "last")).alias("col")).distinct()
    centres = [(c, r) for r in range(26) for c in range(26)]
    at = spark.createDataFrame([(r, c, 11.0 - (r + 0.5) * 0.5, -1.0 + (c + 0.5) * 0.5) for c, r in centres], "row int, col int, lat double, lon double")
    expected = P.containing(at, Y.edges(t, "k"), ["row", "col"], "k", boundary="half_open")
    assert sorted((r.k, r.row, r.col) for r in runs.collect()) == sorted((r.k, r.row, r.col) for r in expected.collect())


def union_of(spark, shapes, groups):
    members = spark.createDataFrame(list(groups.items()), "k string, g string")
    return Y.dissolve(Y.edges(table(spark, shapes), "k"), "k", members, "g").cache()


def flat_area(e):
    return {r.g: r.a for r in e.groupBy("g").agg(F.expr("sum(x1 * y2 - x2 * y1) / 2 as a")).collect()}


def test_union_of_overlapping_squares(spark):
    shapes = {"a": [[square(0, 0, 4, 4)]], "b": [[square(2, 1, 6, 3)]], "c": [[square(10, 0, 11, 1)]], "d": [[square(0, 0, 4, 4)]], "e": [[square(1, 1, 2, 2)]]}
    e = union_of(spark, shapes, {"a": "g", "b": "g", "c": "g", "d": "g", "e": "g"})
    assert flat_area(e) == {"g": 16 + 8 - 4 + 1}
    assert hit(spark, [(3, 2), (5, 2), (10.5, 0.5), (5, 3.5), (1.5, 1.5)], e, "g") == [(0, "g"), (1, "g"), (2, "g"), (4, "g")]


def test_shared_borders_vanish(spark):
    shapes = {"a": [[square(0, 0, 2, 2)]], "b": [[square(2, 0, 4, 2)]], "c": [[[(0, 2), (1, 2), (4, 2), (4, 4), (0, 4)]]]}
    e = union_of(spark, shapes, {"a": "g", "b": "g", "c": "g"})
    assert flat_area(e) == {"g": 16}
    assert hit(spark, [(2, 1), (3, 2), (2, 2)], e, "g", boundary="within") == [(0, "g"), (1, "g"), (2, "g")]
    assert hit(spark, [(2, 1), (4, 1)], e, "g", boundary="covers") == [(0, "g"), (1, "g")]


def test_a_hole_that_another_member_fills_in_part(spark):
    shapes = {"a": [[square(0, 0, 8, 8), square(2, 2, 6, 6)]], "b": [[square(1, 3, 4, 5)]]}
    e = union_of(spark, shapes, {"a": "g", "b": "g"})
    assert flat_area(e) == {"g": 64 - 16 + 4}
    assert hit(spark, [(3, 4), (5, 4), (3, 5.5)], e, "g") == [(0, "g")]


@pytest.mark.parametrize("seed", range(4))
def test_union_of_random_convex_members_is_containment_in_any(spark, seed):
    rng = random.Random(seed)

    def triangle():
        while True:
            p = [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(3)]
            if abs((p[1][0] - p[0][0]) * (p[2][1] - p[0][1]) - (p[1][1] - p[0][1]) * (p[2][0] - p[0][0])) > 1:
                return p

    shapes = {f"t{i}": [[triangle()]] for i in range(12)}
    groups = {k: f"g{i % 2}" for i, k in enumerate(shapes)}
    at = [(rng.uniform(-1, 11), rng.uniform(-1, 11)) for _ in range(400)]
    any_member = {(i, groups[k]) for i, k in hit(spark, at, Y.edges(table(spark, shapes), "k"), "k")}
    assert set(hit(spark, at, union_of(spark, shapes, groups), "g")) == any_member


def test_quality_and_admission_reasons(spark):
    regions = Y.edges(table(spark, {"r": [[square(0, 0, 10, 10)]]}), "k").withColumnRenamed("k", "region")
    blocks = spark.createDataFrame([(1, "r", 5.0, 5.0), (2, "r", 5.0, 15.0), (3, "x", 5.0, 5.0), (4, "r", None, 5.0), (5, "old", 10.0, 5.0)], "id int, stated string, lat double, lon double")
    out = P.spatial_quality(blocks, regions, "id", "region", stated="stated", lat="lat", lon="lon", aliases={"old": "r"}, notes={"old": "older border"})
    assert {r.id: (r.quality_flag, r.in_stated_region, r.note) for r in out.collect()} == {
        1: ("accepted", True, None), 2: ("source_location_mismatch", False, "centroid outside r"), 3: ("boundary_lookup_unavailable", None, "no boundary for x"), 4: ("unavailable", None, "no geometry"), 5: ("accepted", True, "older border"),
    }
    shapes = {"ok": [[square(1, 1, 2, 2)]], "out": [[square(11, 1, 12, 2)]], "two": [[[(0, 0), (1, 1)]]], "bad": [[[(0, 0), (2, 2), (2, 0), (0, 2), (1.2, 1)]]], "big": [[square(1, 1, 2, 2)]], "noarea": [[square(1, 1, 2, 2)]], "noregion": [[square(1, 1, 2, 2)]]}
    area = Y.polygon_metrics(table(spark, {"ok": shapes["ok"]}), "k").first().area_ha
    stated = spark.createDataFrame([(k, None if k == "noregion" else "r", None if k == "noarea" else area * (1.06 if k == "big" else 1.04), area) for k in [*shapes, "none"]], "k string, region string, a double, b double")
    got = P.admit_geometry(table(spark, shapes), stated, regions, "k", "region", areas=["a", "b"])
    assert {r.k: r.reason for r in got.collect()} == {"ok": "admitted", "out": "outside_region", "two": "too_few_vertices", "bad": "invalid_ring", "big": "area_differs", "noarea": "area_missing", "noregion": "no_stated_region", "none": "no_geometry"}


@pytest.mark.parametrize("boundary", ["within", "covers", "half_open"])
def test_listed_and_paired_edges_give_the_same(spark, monkeypatch, boundary):
    """Whether a bucket's edges are a list, pairs or some of both; points whose edges are listed are never grouped."""
    at = {i: (i % 23 * 0.5 - 0.5, i // 23 * 0.5 - 0.5) for i in range(460)} | {900: (None, 1.0), 901: (500.0, 1.0)}
    rows, calls = spark.createDataFrame([(i, *p) for i, p in at.items()], "id int, lon double, lat double"), []
    data = [(k, 0, n, float(x), float(y)) for k, (dx, dy) in enumerate([(0, 0), (1, 1), (2, 0), (6, 3)]) for n, (x, y) in enumerate([(dx, dy), (dx + 3, dy), (dx + 4, dy + 2), (dx, dy + 4)])]
    v = spark.createDataFrame(data, "k int, part int, seq int, x double, y double")
    pairs = P._in_pairs
    monkeypatch.setattr(P, "_in_pairs", lambda p, e, *rest: (calls.append(e.count()), pairs(p, e, *rest))[1])
    found = []
    for listed in (4096, 5, 0):
        monkeypatch.setattr(P, "LISTED", listed)
        inside = sorted((r.id, r.k) for r in P.containing(rows, P.edges(v, "k"), ["id"], "k", boundary=boundary).collect())
        joined = {r.id: r.k for r in P.point_in_polygon_join(rows, v, ["id"], "k", boundary=boundary).collect()}
        assert joined == {i: min((k for j, k in inside if j == i), default=None) for i in at}
        found.append(inside)
    assert found[0] == found[1] == found[2] and len(found[0]) > 50
    assert calls[:2] == [0, 0] < calls[2:4] < calls[4:]
