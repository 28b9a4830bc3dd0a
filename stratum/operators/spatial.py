"""Hexagonal cells as column arithmetic, cell tables, spatial statistics, regions and context layers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions import stats as S

# Axial hexagons on an equirectangular plane. Size halves with each resolution; ids differ from
# other hexagon systems, statistics don't depend on the ids.
EDGE0 = 40.0  # degrees from centre to corner at resolution 0
NEIGHBOURS = [(1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)]


def edge(resolution: int) -> float:
    return EDGE0 / 2**resolution


def axial(lat: Column, lon: Column, resolution: int) -> tuple[Column, Column]:
    """Axial coordinates (q, r) of a point, by cube rounding."""
    s = edge(resolution)
    q, r = (math.sqrt(3) / 3 * lon - lat / 3) / s, (2.0 / 3 * lat) / s
    y = -q - r
    rq, rr, ry = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(y + 0.5)
    dq, dr, dy = F.abs(rq - q), F.abs(rr - r), F.abs(ry - y)
    oq = F.when((dq > dr) & (dq > dy), -rr - ry).otherwise(rq)
    orr = F.when((dq > dr) & (dq > dy), rr).when(dr > dy, -rq - ry).otherwise(rr)
    return oq.cast("bigint"), orr.cast("bigint")


def cell_id(q: Column, r: Column, resolution: int) -> Column:
    return F.concat_ws(":", F.lit(str(resolution)), q.cast("string"), r.cast("string"))


def cell_of(lat: Column, lon: Column, resolution: int) -> Column:
    """Cell of a point; null for null, NaN or out-of-range coordinates."""
    ok = lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon)
    q, r = axial(lat, lon, resolution)
    return F.when(ok, cell_id(q, r, resolution))


def centre(cell: Column) -> tuple[Column, Column]:
    """(lat, lon) of a cell's centre."""
    part = F.split(cell, ":")
    s = F.lit(EDGE0) / F.pow(F.lit(2.0), part[0].cast("double"))
    q, r = part[1].cast("double"), part[2].cast("double")
    return s * 1.5 * r, s * math.sqrt(3) * (q + r / 2)


def parent(cell: Column, resolution: int) -> Column:
    """The coarser cell that holds this cell's centre."""
    lat, lon = centre(cell)
    q, r = axial(lat, lon, resolution)
    return cell_id(q, r, resolution)


def disk(cell: Column, k: int) -> Column:
    """All cells at most k steps away, the cell itself among them."""
    part = F.split(cell, ":")
    out = [F.concat_ws(":", part[0], (part[1].cast("bigint") + dq).cast("string"), (part[2].cast("bigint") + dr).cast("string")) for dq in range(-k, k + 1) for dr in range(max(-k, -dq - k), min(k, -dq + k) + 1)]
    return F.array(*out)


def neighbour_graph(cells: DataFrame, cell: str = "cell") -> DataFrame:
    """(cell, nbr): links between occupied cells that touch."""
    c = cells.select(F.col(cell).alias("cell"))
    return c.select("cell", F.explode(F.array_except(disk(F.col("cell"), 1), F.array("cell"))).alias("nbr")).join(c.select(F.col("cell").alias("nbr")), "nbr", "left_semi").select("cell", "nbr")


def boundary_wkt(cell: Column) -> Column:
    """The cell's hexagon as WKT."""
    lat, lon = centre(cell)
    s = F.lit(EDGE0) / F.pow(F.lit(2.0), F.split(cell, ":")[0].cast("double"))
    pts = []
    for k in (0, 1, 2, 3, 4, 5, 0):
        a = math.radians(60 * k - 30)
        pts.append(F.concat_ws(" ", F.format_number(lon + s * math.cos(a), 6), F.format_number(lat + s * math.sin(a), 6)))
    return F.concat(F.lit("POLYGON (("), F.regexp_replace(F.concat_ws(", ", *pts), r"(?<=\d),(?=\d{3})", ""), F.lit("))"))


def cell_table(points: DataFrame, lat: str, lon: str, resolution: int, metrics: list[str], time: str | None = None, min_points: int = 5) -> DataFrame:
    """(cell, events, active_days, <metric>_median...): medians are null below ``min_points`` points."""
    p = points.withColumn("cell", cell_of(F.col(lat), F.col(lon), resolution)).where("cell is not null")
    aggs = [F.count(F.lit(1)).alias("events")] + ([F.countDistinct(F.to_date(time)).alias("active_days")] if time else [])
    aggs += [F.when(F.count(F.lit(1)) >= min_points, F.median(S.finite(F.col(m)))).alias(f"{m}_median") for m in metrics]
    return p.groupBy("cell").agg(*aggs)


def level_shares(points: DataFrame, cell: Column, column: str) -> DataFrame:
    """(cell, level, n, share) of a categorical column's levels in each cell."""
    g = points.select(cell.alias("cell"), F.col(column).cast("string").alias("level")).where("cell is not null and level is not null").groupBy("cell", "level").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("cell")))


def purity(shares: DataFrame, dense: int = 5) -> DataFrame:
    """(purity): mean share of the commonest level over cells with at least ``dense`` points."""
    return shares.groupBy("cell").agg(F.sum("n").alias("n"), F.max("share").alias("top")).where(F.col("n") >= dense).agg(F.avg("top").alias("purity"), F.count(F.lit(1)).alias("cells"))


def spatial_lag(values: DataFrame, graph: DataFrame, value: str, out: str = "lag", ring: int | None = None) -> DataFrame:
    """Adds the mean of the neighbours; with ``ring`` their sum over that many, absent cells as 0."""
    n = graph.join(values.select(F.col("cell").alias("nbr"), F.col(value).alias("_v")), "nbr").where("_v is not null").groupBy("cell").agg(F.sum("_v").alias("_s"), F.count("_v").alias("_n"))
    joined = values.join(n, "cell", "left")
    lag = F.coalesce("_s", F.lit(0.0)) / ring if ring else F.col("_s") / F.col("_n")
    return joined.withColumn(out, lag).drop("_s", "_n")


def moran_i(values: DataFrame, graph: DataFrame, value: str) -> DataFrame:
    """(n, moran): global Moran's I with row-standardised weights; cells without a neighbour weigh 0."""
    v = values.where(S.finite(F.col(value)).isNotNull()).select("cell", F.col(value).cast("double").alias("v"))
    mean = v.agg(F.avg("v").alias("mean"))
    z = v.crossJoin(F.broadcast(mean)).select("cell", (F.col("v") - F.col("mean")).alias("z"))
    lag = spatial_lag(z, graph, "z")
    a = lag.agg(F.count(F.lit(1)).alias("n"), F.count("lag").alias("w"), F.sum(F.col("z") * F.col("lag")).alias("zl"), F.sum(F.col("z") * F.col("z")).alias("zz"))
    return a.select("n", F.when((F.col("zz") > 0) & (F.col("w") > 0), F.col("n") / F.col("w") * F.col("zl") / F.col("zz")).alias("moran"))


def local_moran(values: DataFrame, graph: DataFrame, value: str, q: float = 0.05) -> DataFrame:
    """(cell, z, lag, score, p, quadrant): local Moran with conditional moments, Benjamini-Hochberg at q.

    Given its own value, a cell's k neighbours are a draw from the others: their mean has expectation
    -z/(n-1) and the variance of a draw without replacement.
    """
    v = values.where(S.finite(F.col(value)).isNotNull()).select("cell", F.col(value).cast("double").alias("v"))
    m = v.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.count(F.lit(1)).alias("n"))
    z = v.crossJoin(F.broadcast(m)).where("sd > 0").select("cell", "n", ((F.col("v") - F.col("mean")) / F.col("sd")).alias("z"))
    k = graph.join(z.select(F.col("cell").alias("nbr")), "nbr", "left_semi").groupBy("cell").agg(F.count(F.lit(1)).alias("k"))
    x = spatial_lag(z, graph, "z").join(k, "cell").where("lag is not null and n > 2")
    n1 = F.col("n") - 1
    e = -F.col("z") / n1
    var_pop = (F.col("n") - F.col("z") * F.col("z")) / n1 - e * e
    var = var_pop / F.col("k") * (n1 - F.col("k")) / (n1 - 1)
    x = x.withColumn("score", F.when(var > 0, (F.col("lag") - e) / F.sqrt(var)).otherwise(0.0)).withColumn("p", S.two_sided(F.col("score")))
    x = S.benjamini_hochberg(x, "p", [], "q")
    quad = F.when(F.col("q") > q, "ns").when((F.col("z") >= 0) & (F.col("lag") >= 0), "HH").when((F.col("z") < 0) & (F.col("lag") < 0), "LL").when(F.col("z") >= 0, "HL").otherwise("LH")
    return x.select("cell", "z", "lag", "score", "p", "q", quad.alias("quadrant"))


def compactness(cover: DataFrame, graph: DataFrame) -> DataFrame:
    """(pattern, links, inside, compactness): share of a cover's cell links that stay inside it."""
    out = cover.join(graph, "cell")
    ins = out.join(cover.select("pattern", F.col("cell").alias("nbr"), F.lit(1).alias("in")), ["pattern", "nbr"], "left")
    return ins.groupBy("pattern").agg(F.count(F.lit(1)).alias("links"), F.count("in").alias("inside")).withColumn("compactness", F.col("inside") / F.col("links"))


def footprint(counts: DataFrame, share: float = 0.8) -> DataFrame:
    """(pattern, cell, n): the busiest cells of each pattern up to ``share`` of its points."""
    w = Window.partitionBy("pattern").orderBy(F.desc("n"), "cell").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)) / F.sum("n").over(Window.partitionBy("pattern"))).where(F.col("before") < share).drop("before")


def in_region(cover: DataFrame, occupied: DataFrame, resolution: int, least: float = 0.2) -> DataFrame:
    """(pattern, region, n, share): regions that hold enough of a pattern's cells."""
    c = cover.withColumn("region", parent(F.col("cell"), resolution))
    size = c.groupBy("pattern").agg(F.count(F.lit(1)).alias("size"))
    o = occupied.withColumn("region", parent(F.col("cell"), resolution)).groupBy("region").agg(F.count(F.lit(1)).alias("occupied"))
    g = c.groupBy("pattern", "region").agg(F.count(F.lit(1)).alias("n")).join(size, "pattern").join(o, "region")
    return g.withColumn("share", F.col("n") / F.least("size", "occupied")).where(F.col("share") >= least).select("pattern", "region", "n", "share")


def region_lift(events: DataFrame, least: float = 1.5, q: float = 0.05) -> DataFrame:
    """(pattern, region, x, expected, lift, q): regions where a pattern has more events than its share.

    ``events``: (pattern or null, region) counts. The binomial tail is taken by its normal limit.
    """
    g = events.groupBy("pattern", "region").agg(F.count(F.lit(1)).alias("x"))
    r = events.groupBy("region").agg(F.count(F.lit(1)).alias("nr"))
    p = events.groupBy("pattern").agg(F.count(F.lit(1)).alias("np"))
    n = events.agg(F.count(F.lit(1)).alias("n"))
    t = g.where("pattern is not null").join(r, "region").join(p, "pattern").crossJoin(F.broadcast(n)).withColumn("expected", F.col("np") * F.col("nr") / F.col("n"))
    z = (F.col("x") - 0.5 - F.col("expected")) / F.sqrt(F.col("expected") * (1 - F.col("nr") / F.col("n")))
    t = t.withColumn("p", F.when(z > 0, S.norm_sf(z)).otherwise(0.5)).withColumn("lift", F.col("x") / F.col("expected"))
    t = S.benjamini_hochberg(t, "p", ["pattern"], "q")
    floor = F.least(F.lit(30), F.greatest(F.lit(5), F.ceil(0.05 * F.col("np"))))
    return t.where((F.col("q") <= q) & (F.col("lift") >= least) & (F.col("x") >= floor)).select("pattern", "region", "x", "expected", "lift", "q")


def co_located(cover: DataFrame, graph: DataFrame, most: int = 3) -> DataFrame:
    """(a, b, relation, weight): patterns that share cells (``overlaps``) or touch (``adjacent``), the best per pattern.

    Joined on cells, so that only patterns of one place meet.
    """
    size = cover.groupBy("pattern").agg(F.count(F.lit(1)).alias("size"))
    x, y = cover.alias("x"), cover.alias("y")
    over = x.join(y, F.col("x.cell") == F.col("y.cell")).where("x.pattern < y.pattern").groupBy(F.col("x.pattern").alias("a"), F.col("y.pattern").alias("b")).agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.lit(0))
    touch = cover.join(graph, "cell").select("pattern", F.col("nbr").alias("cell")).distinct().alias("t").join(y, F.col("t.cell") == F.col("y.cell")).where("t.pattern < y.pattern").groupBy(F.col("t.pattern").alias("a"), F.col("y.pattern").alias("b")).agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.lit(1))
    best = over.unionByName(touch).groupBy("a", "b").agg(F.min("rank").alias("rank"), F.min_by("n", "rank").alias("n"))
    w = best.join(size.select(F.col("pattern").alias("a"), F.col("size").alias("sa")), "a").join(size.select(F.col("pattern").alias("b"), F.col("size").alias("sb")), "b").withColumn("weight", F.least(F.lit(1.0), F.col("n") / F.least("sa", "sb")))
    ends = w.select("a", "b", "rank", "weight", F.explode(F.array("a", "b")).alias("end"))
    kept = ends.withColumn("r", F.row_number().over(Window.partitionBy("end").orderBy("rank", F.desc("weight"), "a", "b"))).where(F.col("r") <= most)
    return kept.groupBy("a", "b").agg(F.first("rank").alias("rank"), F.first("weight").alias("weight")).select("a", "b", F.when(F.col("rank") == 0, "overlaps").otherwise("adjacent").alias("relation"), "weight")


def zone_overlap(cover: DataFrame, zone: DataFrame) -> DataFrame:
    """(pattern, score): shared cells over the geometric mean of both cell counts."""
    n = zone.agg(F.countDistinct("cell").alias("z"))
    p = cover.groupBy("pattern").agg(F.count(F.lit(1)).alias("p"))
    hit = cover.join(zone.select("cell").distinct(), "cell", "left_semi").groupBy("pattern").agg(F.count(F.lit(1)).alias("hit"))
    return hit.join(p, "pattern").crossJoin(F.broadcast(n)).select("pattern", (F.col("hit") / F.sqrt(F.col("p") * F.col("z"))).alias("score"))


def context_sums(target: DataFrame, layer: DataFrame, ring: int) -> DataFrame:
    """(cell, n): layer points within ``ring`` steps of each target cell; 0 where there are none."""
    near = target.select("cell", F.explode(disk(F.col("cell"), ring)).alias("at"))
    counts = layer.groupBy(F.col("cell").alias("at")).agg(F.count(F.lit(1)).alias("k"))
    return near.join(counts, "at", "left").groupBy("cell").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))


def context_bands(sums: DataFrame) -> DataFrame:
    """(cell, n, band): band 0 for none, else by the quarters of the positive sums, right-closed."""
    edges = sums.where("n > 0").agg(F.array_distinct(F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).alias("edges"))
    return sums.crossJoin(F.broadcast(edges)).select("cell", "n", F.when(F.col("n") == 0, 0).otherwise(1 + F.size(F.filter("edges", lambda e: F.col("n") > e))).alias("band"))


def dealt(cells: DataFrame, block: str, value: str, seed: int) -> DataFrame:
    """(cell, block, value): values dealt anew among the cells of each block; a block keeps its total."""
    w = Window.partitionBy(block)
    a = cells.withColumn("_i", F.row_number().over(w.orderBy("cell"))).select("cell", block, "_i")
    b = cells.withColumn("_i", F.row_number().over(w.orderBy(F.xxhash64("cell", F.lit(seed)), "cell"))).select(block, "_i", value)
    return a.join(b, [block, "_i"]).select("cell", block, value)
