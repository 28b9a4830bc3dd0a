import json
import math
import random

import pytest

from stratum.operators import proximity as P


def dist(a, b):
    h = math.sin(math.radians(a[1] - b[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(a[2] - b[2]) / 2) ** 2
    return 2 * P.EARTH_M * math.asin(math.sqrt(min(1, h)))


def cloud():
    rng, pts = random.Random(1), []
    for lat, lon in ((41, -87), (89.9995, 10), (-89.9999, 0), (12, 179.9995), (12, -179.9995), (0.001, 0.001), (70, 33)):
        for _ in range(25):
            pts.append((len(pts), max(-90.0, min(90.0, lat + rng.uniform(-0.003, 0.003))), (lon + rng.uniform(-0.004, 0.004) + 180) % 360 - 180))
    return pts + [(1000, 41.0, -87.0), (1001, 41.0, -87.0)]


@pytest.mark.parametrize("hot", [2_000, 3])
def test_near_is_brute_force(spark, hot):
    pts = cloud()
    df = spark.createDataFrame(pts, "point_id bigint, lat double, lon double")
    got = [(r[0], r[1]) for r in P.near_pairs(df, 150.0, hot).collect()]
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and dist(a, b) <= 150}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_usable_points(spark):
    rows = [(1, 1.0, 1.0, "x"), (1, 1.0, 1.0, "y"), (2, None, 1.0, "x"), (3, float("nan"), 1.0, "x"), (4, 0.0, 0.0, "x"), (5, 91.0, 0.0, "x"), (6, 10.0, 180.5, "x"), (7, 90.0, 180.0, "x")]
    got = sorted(r[0] for r in P.usable_points(spark.createDataFrame(rows, "point_id bigint, lat double, lon double, id_a string")).collect())
    assert got == [1, 7]


def inside(lon, lat, ring):
    f, ins = ring[0][0], False
    turn = lambda x: x - 360 * math.floor((x - f + 180) / 360)
    x, pts = turn(lon), [(turn(p[0]), p[1]) for p in ring]
    for (xa, ya), (xb, yb) in zip(pts, pts[1:] + pts[:1], strict=True):
        if (xa > x) != (xb > x) and ya + (yb - ya) * (x - xa) / (xb - xa) < lat:
            ins = not ins
    return ins


def test_regions_are_brute_force(spark):
    rng = random.Random(4)
    star = [[20 + (3 if k % 2 else 1) * math.cos(k * math.pi / 5), 10 + (3 if k % 2 else 1) * math.sin(k * math.pi / 5)] for k in range(10)]
    bow = [[0, 30], [4, 34], [4, 30], [0, 34]]
    hole = [[19.5, 9.5], [20.5, 9.5], [20.5, 10.5], [19.5, 10.5]]
    date = [[179, -5], [181, -5], [181, 5], [179, 5]]
    polys = {1: [star, hole], 2: [bow], 3: [date]}
    zones = [(k, json.dumps({"type": "Polygon", "coordinates": [r + r[:1] for r in v]})) for k, v in polys.items()]
    zones += [(4, json.dumps({"center": [180.0, 0.0], "radius_m": 90_000})), (5, json.dumps({"bbox": [179.5, -1, 180.5, 1]})), (6, "{oops"), (7, None), (8, json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [1, 1]]]})), (9, json.dumps({"center": [0, 90], "radius_m": 200_000}))]
    pts = [(k, rng.uniform(5, 15), rng.uniform(15, 25)) for k in range(300)] + [(400 + k, rng.uniform(29, 35), rng.uniform(-1, 5)) for k in range(200)] + [(700 + k, rng.uniform(-6, 6), rng.choice([-1, 1]) * rng.uniform(178.5, 180)) for k in range(300)] + [(1100 + k, rng.uniform(87, 90), rng.uniform(-180, 180)) for k in range(40)]
    got = {(r["zone_id"], r["point_id"]) for r in P.points_in_regions(spark.createDataFrame(pts, "point_id bigint, lat double, lon double"), spark.createDataFrame(zones, "zone_id bigint, geometry string")).collect()}
    want = set()
    for p, lat, lon in pts:
        for z, rings in polys.items():
            if inside(lon, lat, rings[0]) and not any(inside(lon, lat, h) for h in rings[1:]):
                want.add((z, p))
        if dist((0, lat, lon), (0, 0.0, 180.0)) <= 90_000:
            want.add((4, p))
        if -1 <= lat <= 1 and (lon >= 179.5 or lon <= -179.5):
            want.add((5, p))
        if dist((0, lat, lon), (0, 90.0, 0.0)) <= 200_000:
            want.add((9, p))
    assert got == want and len({z for z, _ in want}) == 6


def test_empty(spark):
    p, z = spark.createDataFrame([], "point_id bigint, lat double, lon double"), spark.createDataFrame([], "zone_id bigint, geometry string")
    assert P.found_near_and_inside(p, z).count() == 0


def test_bad_parts_take_no_good_ones_away():
    square = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    rings = lambda g: [len(p[1]) for p in P.parse_region(json.dumps(g))]
    assert rings({"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 1]]], [square], [[["a", 0], [1, 1], [2, 2]]]]}) == [1]
    assert rings({"type": "Polygon", "coordinates": [square, [[1, 1], [1.5, 1]]]}) == [1]
    assert rings({"type": "Polygon", "bbox": [0, 0, 2, 2], "coordinates": [square]}) == [1]
    assert P.parse_region('{"bbox": [0, 1, -5, 2, 3, 9]}') == [("box", 0.0, 1.0, 2.0, 3.0)]
    for bad in (None, "", "[]", "3", '{"type":"Point","coordinates":[1,2]}', '{"type":"Polygon","coordinates":[]}', '{"type":"Feature","geometry":null}', '{"bbox":[1,2,3]}', '{"center":[1],"radius_m":4}'):
        assert P.parse_region(bad) == []
