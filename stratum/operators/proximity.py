"""Points near other points, and points inside regions, on the sphere."""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.runtime import saved, small, spread

EARTH_M = 6_371_008.8
HOT = 2_000  # points of one grid cell that a task compares with one probe group


def usable_points(points: DataFrame) -> DataFrame:
    """(point_id, lat, lon): in range, not (0, 0), neither null nor NaN; repeated rows once."""
    p = points.select("point_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    return p.where("point_id is not null and lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0) and not isnan(lat) and not isnan(lon)").distinct()


def near_pairs(points: DataFrame, metres: float, hot: int = HOT) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs at most ``metres`` apart along the sphere.

    ``points``: (point_id, lat, lon), as of :func:`usable_points`. Bands of latitude, 2 x metres
    high, hold cells at least 2 x metres wide, whose number falls towards the poles and which close
    at 180 degrees. Each point lives in one cell and probes the one to four cells its circle touches,
    which are joined by equality; a pair is kept at the probe of the smaller id, hence once. A cell
    of more than ``hot`` points is dealt into salted parts and its probes are repeated for each part.
    Copies of a place with different ids are different points and all pair up.
    """
    step = math.degrees(2 * metres / EARTH_M)
    n_bands = max(1, math.ceil(180 / step))
    r = math.degrees(metres / EARTH_M) * (1 + 1e-9)

    def n_cells(band):
        """Cells in a band: as many as fit at its widest-angle latitude."""
        far = F.least(F.lit(90.0), F.greatest(F.abs(band * step - 90), F.abs((band + 1) * step - 90)))
        return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(far)) / step)).cast("bigint")

    band = F.least(F.lit(n_bands - 1), F.floor((F.col("lat") + 90) / step)).cast("bigint")
    xyz = [(F.cos(F.radians("lat")) * F.cos(F.radians("lon"))).alias("x"), (F.cos(F.radians("lat")) * F.sin(F.radians("lon"))).alias("y"), F.sin(F.radians("lat")).alias("z")]
    p = points.select("point_id", "lat", "lon", *xyz)
    home = p.withColumn("band", band).withColumn("cell", F.floor((F.col("lon") + 180) / 360 * n_cells(F.col("band"))) % n_cells(F.col("band"))).select("band", "cell", F.col("point_id").alias("id_b"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("z").alias("zb"))

    # the widest difference of longitude within the circle; all longitudes if a pole is within it
    sine = F.lit(math.sin(metres / EARTH_M)) / F.cos(F.radians("lat"))
    wide = F.when((F.abs("lat") + r >= 90) | (sine >= 1), F.lit(180.0)).otherwise(F.degrees(F.asin(sine)) * (1 + 1e-9))
    probe = p.withColumn("wide", wide).withColumn("band", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("lat") - r + 90) / step)).cast("bigint"), F.least(F.lit(n_bands - 1), F.floor((F.col("lat") + r + 90) / step)).cast("bigint")))).withColumn("n", n_cells(F.col("band")))
    lo, hi = (F.floor((F.col("lon") + s * F.col("wide") + 180) / 360 * F.col("n")) for s in (-1, 1))
    cells = F.when(F.col("wide") >= 180, F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).otherwise(F.array_distinct(F.transform(F.sequence(lo, F.least(hi, lo + F.col("n") - 1)), lambda c: F.pmod(c, F.col("n")))))
    probe = probe.withColumn("cell", F.explode(cells)).select("band", "cell", F.col("point_id").alias("id_a"), "x", "y", "z")

    crowded = saved(home.groupBy("band", "cell").count().where(F.col("count") > hot).select("band", "cell", F.ceil(F.col("count") / hot).cast("int").alias("parts")), "crowded")
    if crowded.isEmpty():
        home, probe, keys = home, probe, ["band", "cell"]
    else:
        crowded = small(crowded, 100_000)
        home = home.join(crowded, ["band", "cell"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id_b"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
        probe = probe.join(crowded, ["band", "cell"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("parts")
        keys = ["band", "cell", "part"]
    chord2 = (2 * math.sin(metres / EARTH_M / 2)) ** 2
    d2 = (F.col("x") - F.col("xb")) * (F.col("x") - F.col("xb")) + (F.col("y") - F.col("yb")) * (F.col("y") - F.col("yb")) + (F.col("z") - F.col("zb")) * (F.col("z") - F.col("zb"))
    return probe.join(home, keys).where((F.col("id_a") < F.col("id_b")) & (d2 <= chord2)).select("id_a", "id_b")


# --- regions -------------------------------------------------------------------------------------


def _number(x) -> float:
    if isinstance(x, bool) or not isinstance(x, int | float) or not math.isfinite(x):
        raise ValueError("no number")
    return float(x)


def _ring(coords) -> list[tuple[float, float]]:
    """A ring with its longitudes within 180 degrees of its first, without its closing repeat; empty if it encloses nothing."""
    pts = [(_number(c[0]), _number(c[1])) for c in coords]
    if len(pts) > 1 and pts[0] == pts[-1]:
        pts.pop()
    if len(set(pts)) < 3:
        return []
    first = pts[0][0]
    return [(x - 360 * math.floor((x - first + 180) / 360), y) for x, y in pts]


def _polygon(rings) -> list[tuple]:
    """The part of one polygon: none if its outer ring encloses nothing or a ring can't be read."""
    try:
        rings = [_ring(r) for r in rings]
    except (ValueError, TypeError, KeyError, IndexError):
        return []
    return [("rings", [rings[0], *filter(None, rings[1:])])] if rings and rings[0] else []


def parse_region(text: str | None) -> list[tuple]:
    """Parts of a region: ("rings", [ring, hole...]), ("circle", lon, lat, metres), ("box", w, s, e, n).

    An unreadable shape, null included, has no parts; a polygon that is unreadable or encloses nothing
    takes no part of a shape of several away, nor does a hole without area take its polygon. A shape
    with a type is that, whatever other members it has.
    """
    try:
        g = json.loads(text)
        while isinstance(g, dict) and g.get("type") == "Feature":
            g = g["geometry"]
        if g.get("type") == "Polygon":
            return _polygon(g["coordinates"])
        if g.get("type") == "MultiPolygon":
            return [part for p in g["coordinates"] for part in _polygon(p)]
        if "center" in g:
            lon, lat = map(_number, g["center"][:2])
            metres = _number(g["radius_m"])
            return [("circle", lon, lat, metres)] if metres >= 0 and abs(lat) <= 90 else []
        box = [_number(x) for x in g["bbox"]]
        w, s, e, n = box if len(box) != 6 else (box[0], box[1], box[3], box[4])
        return [("box", w, s, e + 360 if e < w else e, n)] if s <= n else []
    except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError):
        return []


def trapezoid_slabs(rings: list[list[tuple[float, float]]]) -> list[tuple[float, float, list[tuple[float, float, float, float]]]]:
    """Slabs (x0, x1, edges) of a polygon with holes; edges: (y at x0, y at x1), from bottom to top.

    Slabs end at each vertex and at each crossing of two edges, so that edges in a slab are in one
    order. Only edges where "in the outer ring and in no hole" changes are kept: a point is inside
    if an odd number of the kept edges lies below it.
    """
    base = rings[0][0][0]
    edges = []
    for k, ring in enumerate(rings):
        shift = -360 * math.floor((ring[0][0] - base + 180) / 360) if k else 0
        pts = [(x + shift, y) for x, y in ring]
        for (xa, ya), (xb, yb) in zip(pts, pts[1:] + pts[:1], strict=True):
            if xa != xb:
                edges.append((xa, ya, xb, yb, k) if xa < xb else (xb, yb, xa, ya, k))
    edges.sort()
    xs = sorted({x for e in edges for x in (e[0], e[2])})
    at = lambda e, x: e[1] + (e[3] - e[1]) * ((x - e[0]) / (e[2] - e[0]))
    out, live, nxt = [], [], 0
    for x0, x1 in zip(xs, xs[1:], strict=False):
        live = [e for e in live if e[2] > x0]
        while nxt < len(edges) and edges[nxt][0] <= x0:
            live.append(edges[nxt])
            nxt += 1
        cuts = {x0, x1}
        order = sorted(live, key=lambda e: (at(e, x0), at(e, x1)))
        ends = [at(e, x1) for e in order]
        if any(b < a for a, b in zip(ends, ends[1:], strict=False)):
            for i, e in enumerate(order):
                for f in order[i + 1 :]:
                    d0, d1 = at(e, x0) - at(f, x0), at(e, x1) - at(f, x1)
                    if d0 * d1 < 0:
                        cuts.add(x0 + (x1 - x0) * d0 / (d0 - d1))
        cut = sorted(cuts)
        for a, b in zip(cut, cut[1:], strict=False):
            mid, odd, inside, kept = (a + b) / 2, set(), False, []
            for e in sorted(live, key=lambda e: at(e, mid)):
                odd ^= {e[4]}
                now = odd == {0}
                if now != inside:
                    kept.append((at(e, a), at(e, b)))
                    inside = now
            if kept:
                out.append((a, b, kept))
    return out


LEVELS = 9  # cells of 0.01 degrees x 4^level: the last covers the world
BASE_DEG = 0.01
MAX_CELLS = 16


def _cover(w: float, s: float, e: float, n: float) -> list[tuple[int, int, int]]:
    """At most MAX_CELLS or so grid cells (level, column, row) over a box; longitudes may pass 180."""
    if e - w >= 360:
        w, e = -180.0, 180.0
    for level in range(LEVELS):
        d = BASE_DEG * 4**level
        nx, ny = math.floor((e + 180) / d) - math.floor((w + 180) / d) + 1, math.floor((n + 90) / d) - math.floor((s + 90) / d) + 1
        if nx * ny <= MAX_CELLS or level == LEVELS - 1:
            break
    cells = set()
    for shift in (-720, -360, 0, 360, 720):  # the parts of the box that points, within -180..180, can lie in
        a, b = max(w + shift, -180.0), min(e + shift, 180.0)
        if a <= b:
            for i in range(math.floor((a + 180) / d), math.floor((b + 180) / d) + 1):
                for j in range(math.floor((max(s, -90) + 90) / d), math.floor((min(n, 90) + 90) / d) + 1):
                    cells.add((level, i, j))
    return sorted(cells)


def region_pieces(zones: DataFrame, id_col: str = "zone_id", geometry: str = "geometry") -> DataFrame:
    """Pieces of each region, each with the grid cells it touches.

    (level, i, j, zone_id, kind, x0, x1, y0, y1, low, high): for kind 0 a slab from x0 to x1 whose
    edges are (low, high) arrays of y at its two ends; for 1 a circle with centre (x0, y0) and
    radius x1; for 2 a box.
    """

    def run(batches):
        for b in batches:
            out = []
            for zid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for part in parse_region(text):
                    if part[0] == "rings":
                        for x0, x1, kept in trapezoid_slabs(part[1]):
                            low, high = [k[0] for k in kept], [k[1] for k in kept]
                            s, n = min(min(low), min(high)), max(max(low), max(high))
                            out += [(*c, zid, 0, x0, x1, s, n, low, high) for c in _cover(x0, s, x1, n)]
                    elif part[0] == "circle":
                        _, lon, lat, m = part
                        dy = math.degrees(m / EARTH_M) * (1 + 1e-9)
                        sine = math.sin(min(m / EARTH_M, math.pi / 2)) / max(1e-12, math.cos(math.radians(lat)))
                        dx = 180.0 if abs(lat) + dy >= 90 or sine >= 1 else math.degrees(math.asin(sine)) * (1 + 1e-9)
                        out += [(*c, zid, 1, lon, m, lat, lat, [], []) for c in _cover(lon - dx, max(-90.0, lat - dy), lon + dx, min(90.0, lat + dy))]
                    else:
                        _, w, s, e, n = part
                        out += [(*c, zid, 2, w, e, s, n, [], []) for c in _cover(w, s, e, n)]
            for k in range(0, len(out), 20_000):
                cols = list(zip(*out[k : k + 20_000], strict=True))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.float64()] * 4, pa.list_(pa.float64()), pa.list_(pa.float64())]
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names="level i j zone_id kind x0 x1 y0 y1 low high".split())

    z = zones.select(F.col(id_col).cast("bigint").alias("zone_id"), F.col(geometry).cast("string").alias("geometry")).where("zone_id is not null and geometry is not null")
    tasks = spread(zones.sparkSession, 0)  # regions are few and costly: one task for each core, not one for all
    z = z.repartition(max(tasks, zones.sparkSession.sparkContext.defaultParallelism), "zone_id").dropDuplicates()
    return z.mapInArrow(run, "level int, i bigint, j bigint, zone_id bigint, kind int, x0 double, x1 double, y0 double, y1 double, low array<double>, high array<double>")


def points_in_regions(points: DataFrame, zones: DataFrame) -> DataFrame:
    """(zone_id, point_id): points inside each region, pairs once.

    Region boundaries are split into slabs (:func:`trapezoid_slabs`), which are distributed over grid
    cells of the level at which a slab touches few; points join the slabs of their cells and find
    their place among a slab's ordered edges by binary search. Edges are straight in degrees, a
    slab holds its left end but not its right one. Circles are measured along the sphere and boxes
    include their edges. Several regions with one id act as one.
    """
    pieces = saved(region_pieces(zones), "pieces")
    held = pieces.agg(F.collect_set("level"), F.count(F.lit(1)), F.sum(F.size("low"))).first()
    levels, n_pieces, n_edges = held[0], held[1], held[2] or 0  # levels: at most LEVELS
    if not levels:
        return points.select(F.lit(0).cast("bigint").alias("zone_id"), F.col("point_id")).limit(0)
    sizes = F.array(*[F.struct(F.lit(v).alias("level"), F.lit(BASE_DEG * 4**v).alias("d")) for v in sorted(levels)])
    p = points.select("point_id", "lat", "lon", F.explode(sizes).alias("g")).select("point_id", "lat", "lon", F.col("g.level").alias("level"), F.floor((F.col("lon") + 180) / F.col("g.d")).alias("i"), F.floor((F.col("lat") + 90) / F.col("g.d")).alias("j"))
    # the point's longitude, turned so that it isn't before the piece's west end by more than a turn
    turned = F.col("lon") - 360 * F.floor((F.col("lon") - F.col("x0")) / 360)
    light = n_pieces <= 50_000 and n_edges <= 1_000_000  # 16 bytes an edge
    j = p.join(F.broadcast(pieces) if light else pieces, ["level", "i", "j"])
    share = (F.col("t") - F.col("x0")) / (F.col("x1") - F.col("x0"))
    steps = F.expr("sequence(1, cast(ceil(log2(size(low) + 1)) as int))")
    mid = lambda a: ((a["lo"] + a["hi"]) / 2).cast("int")
    y_at = lambda k: F.get("low", k) + (F.get("high", k) - F.get("low", k)) * F.col("share")
    search = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size("low").alias("hi")), lambda a, _: F.when(a["lo"] >= a["hi"], a).when(y_at(mid(a)) < F.col("lat"), F.struct((mid(a) + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), mid(a).alias("hi"))), lambda a: a["lo"])
    polygon = j.where("kind = 0 and lat between y0 and y1").withColumn("t", turned).where("t >= x0 and t < x1").withColumn("share", share).where(search % 2 == 1)
    h = F.pow(F.sin(F.radians(F.col("lat") - F.col("y0")) / 2), 2) + F.cos(F.radians("lat")) * F.cos(F.radians("y0")) * F.pow(F.sin(F.radians(F.col("lon") - F.col("x0")) / 2), 2)
    circle = j.where("kind = 1").where(2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(h))) <= F.col("x1"))
    box = j.where("kind = 2 and lat between y0 and y1").where((turned <= F.col("x1")) | (F.col("lon") == F.col("x1")))
    ids = ["zone_id", "point_id"]
    return polygon.select(*ids).unionByName(circle.select(*ids)).unionByName(box.select(*ids)).distinct()


def found_near_and_inside(points: DataFrame, zones: DataFrame, metres: float = 150.0) -> DataFrame:
    """(kind, id_a, id_b): ``near`` pairs of points and ``zone`` rows (zone, point)."""
    p = saved(usable_points(points), "points")
    near = near_pairs(p, metres).select(F.lit("near").alias("kind"), "id_a", "id_b")
    inside = points_in_regions(p, zones).select(F.lit("zone").alias("kind"), F.col("zone_id").alias("id_a"), F.col("point_id").alias("id_b"))
    return near.unionByName(inside)
