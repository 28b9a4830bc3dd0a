"""The whole cohort search: space, closed cohorts, scores, pruning, validation and selection.

Rows with the same levels are in the same conjunctions, so everything about membership (sizes,
closed intents, overlaps, histograms, sums for correlations) is worked out on distinct combinations
of levels, not on rows. The fact is read once, into the table of :func:`cube`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions import stats as S
from stratum.runtime import saved, small, widened

MASS, BUDGET, KEPT, NEAR = 0.95, 5_000, 50, 0.88
NULL_LEVELS = ("nan", "<NA>", "None")
BINS, FINE = 128, 512  # bins of a metric's histogram that find a median's bin, and for resamples
REPS = 20
DRIVER_JS, DRIVER_P, HIDDEN_Z = 0.15, 0.01, 1.5


def _nine(c: Column) -> Column:
    """Nine significant digits, so that a sum of doubles doesn't depend on the order of its terms."""
    return F.format_string("%.8e", c).cast("double")


@dataclass
class Cube:
    """A table by its combinations of levels."""

    rows: DataFrame  # (c, metrics...): the combination and the metrics of each row
    combos: DataFrame  # (c, dims..., n)
    dims: list[str]
    metrics: list[str]
    n_rows: int


def cube(df: DataFrame, dims: list[str], metrics: list[str]) -> Cube:
    """Reads the table once. Dimensions are compared as text; a metric's NaN is null."""
    dims = sorted(dims)
    wide = widened(df.select(*[F.col(d).cast("string").alias(d) for d in dims], *[S.finite(F.col(m)).alias(m) for m in metrics]))
    c = F.xxhash64(F.to_json(F.struct(*dims), {"ignoreNullFields": "false"}))
    kept = saved(wide.withColumn("c", c), "fact")
    combos = saved(kept.groupBy("c", *dims).agg(F.count(F.lit(1)).alias("n")), "combos")
    return Cube(kept.select("c", *metrics), combos, dims, metrics, int(combos.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))


def _members(x: DataFrame, sets: list[tuple[str, ...]], marks: list[Column], dims: list[str]) -> DataFrame:
    """(c, n, expression, size, support, k) of combinations; a level whose mark is null is in no conjunction."""
    mark = dict(zip(dims, marks, strict=True))
    ok = lambda s: sum((mark[d].isNull().cast("int") for d in s), F.lit(0)) == 0
    text = lambda s: F.concat_ws(" AND ", *[F.concat(F.lit(f"{d}=='"), F.col(d), F.lit("'")) for d in s])
    items = [F.when(ok(s), F.struct(text(s).alias("expression"), F.lit(len(s)).alias("size"), math.prod((mark[d] for d in s), start=F.lit(1.0)).alias("support"))) for s in sets]
    member = x.select("c", "n", F.explode(F.array(*items)).alias("x")).where("x is not null").select("c", "n", "x.*")
    return member.withColumn("k", F.xxhash64("expression"))


def all_conjunctions(df: DataFrame, dims: list[str], metrics: list[str], sizes: tuple[int, ...] = (2,), min_rows: int = 1) -> DataFrame:
    """(expression, metric, n, local_median): exact medians of every conjunction of ``sizes`` conditions on distinct dimensions."""
    q = cube(df, dims, metrics)
    sets = [s for n in sizes for s in combinations(q.dims, n)]
    member = saved(_members(q.combos, sets, [F.when(F.col(d).isNotNull(), F.lit(1.0)) for d in q.dims], q.dims), "members")
    names = member.groupBy("k").agg(F.first("expression").alias("expression"))
    return medians(q, member).where(F.col("n_values") >= min_rows).join(names, "k").select("expression", "metric", F.col("n_values").alias("n"), "local_median")


def search_space(q: Cube, mass: float = MASS, budget: int = BUDGET) -> DataFrame:
    """(c, n, k, expression, size): each combination's conjunctions.

    Levels of a dimension are taken by share, up to and including the one that crosses ``mass``.
    Conjunctions are all pairs of levels of different dimensions, and all triples if both together
    are at most ``budget``; if the pairs alone are more, the ``budget`` of them with the largest
    products of shares.
    """
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("level")) for d in q.dims])).alias("x")
    counts = q.combos.select("n", each).select("n", "x.*").where(F.col("level").isNotNull() & ~F.col("level").isin(*NULL_LEVELS)).groupBy("dim", "level").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("dim").orderBy(F.desc("n"), "level")
    share = F.col("n") / F.sum("n").over(Window.partitionBy("dim"))
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / F.sum("n").over(Window.partitionBy("dim"))
    levels = saved(counts.select("dim", "level", share.alias("share"), before.alias("before")).where(F.col("before") < mass).drop("before"), "levels")
    n = {r["dim"]: r["count"] for r in levels.groupBy("dim").count().collect()}  # a row a dimension
    product = lambda sets: sum(math.prod(n.get(d, 0) for d in s) for s in sets)
    pairs, triples = list(combinations(q.dims, 2)), list(combinations(q.dims, 3))
    sets = pairs + triples if product(pairs) + product(triples) <= budget else pairs
    x = q.combos
    for d in q.dims:  # levels that aren't searched become null
        known = small(levels.where(F.col("dim") == d).select(F.col("level").alias(d), F.col("share").alias(f"{d}_share")), 100_000)
        x = x.join(known, d, "left")
    member = saved(_members(x, sets, [F.col(f"{d}_share") for d in q.dims], q.dims), "members")
    if product(pairs) > budget:
        top = member.groupBy("k").agg(F.first("support").alias("support"), F.first("expression").alias("e")).orderBy(F.desc("support"), "e").limit(budget).select("k")
        member = member.join(F.broadcast(saved(top, "space")), "k", "left_semi")
    return member.select("c", "n", "k", "expression", "size")


def closed_cohorts(q: Cube, member: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cohorts, their combinations): screened conjunctions, those with the same rows as one.

    cohorts: (k, expression, intent, n, aliases). The closed intent of a conjunction is every
    condition that all its rows meet; conjunctions have the same rows just if they have the same
    intent. ``expression`` is the one with the most conditions, then the least text. Screened are
    those with at least max(5 metrics, floor(N / 200)) rows, but not all.
    """
    floor = max(5 * len(q.metrics), q.n_rows // 200)
    only = lambda d: (F.count(d) == F.count(F.lit(1))) & (F.min(d) == F.max(d)) & ~F.min(d).isin(*NULL_LEVELS)
    conds = F.array_compact(F.array(*[F.when(only(d), F.concat(F.lit(f"{d}=='"), F.min(d), F.lit("'"))) for d in q.dims]))
    per = member.join(small(q.combos.drop("n"), 100_000), "c").groupBy("k", "expression", "size").agg(F.sum("n").alias("n"), F.concat_ws(" AND ", conds).alias("intent"))
    per = per.where((F.col("n") >= floor) & (F.col("n") < q.n_rows))
    one = per.groupBy("intent").agg(F.min(F.struct((-F.col("size")).alias("s"), "expression", "k")).alias("h"), F.first("n").alias("n"), F.array_sort(F.collect_list("expression")).alias("all"))
    heads = saved(one.select("h.k", "h.expression", "intent", "n", F.array_remove(F.col("all"), F.col("h.expression")).alias("aliases")), "cohorts")
    return heads, saved(member.join(small(heads.select("k"), 100_000), "k", "left_semi").select("k", "c", "n"), "extents")


def _edges(q: Cube) -> dict[str, tuple[float, float]]:
    row = q.rows.agg(*[F.percentile_approx(m, F.array(F.lit(0.01), F.lit(0.99)), F.lit(1000)).alias(m) for m in q.metrics]).first()
    return {m: (row[m][0], row[m][1]) if row[m] else (0.0, 0.0) for m in q.metrics}


def _binned(q: Cube, edges: dict, bins: int) -> Column:
    def one(m: str) -> Column:
        lo, hi = edges[m]
        b = F.greatest(F.lit(-1), F.least(F.lit(bins), F.floor((F.col(m) - lo) / ((hi - lo) or 1.0) * bins))).cast("int")
        return F.when(F.col(m).isNotNull(), F.struct(F.lit(q.metrics.index(m)).alias("m"), F.col(m).alias("v"), b.alias("b")))

    return F.explode(F.array(*[one(m) for m in q.metrics])).alias("x")


def medians(q: Cube, extents: DataFrame) -> DataFrame:
    """(k, metric, n_values, local_median): exact medians of each cohort, from histograms of combinations.

    The histograms tell the bins that hold a cohort's middle values; only values in those bins are
    then counted one by one.
    """
    x = q.rows.select("c", _binned(q, _edges(q), BINS)).where("x is not null").select("c", "x.m", "x.v", "x.b")
    hist = saved(x.groupBy("c", "m", "b").agg(F.count(F.lit(1)).alias("h")), "hist")
    ext = small(extents.select("k", "c"), 500_000)
    w = Window.partitionBy("k", "m")
    up = hist.join(ext, "c").groupBy("k", "m", "b").agg(F.sum("h").alias("h")).withColumn("up", F.sum("h").over(w.orderBy("b"))).withColumn("n", F.sum("h").over(w))
    below = F.col("up") - F.col("h")
    mid = up.where(((F.col("up") * 2 >= F.col("n")) & (below * 2 < F.col("n"))) | ((F.col("up") * 2 > F.col("n")) & (below * 2 <= F.col("n")))).select("k", "m", "b", "n", below.alias("before"))
    mid = saved(mid, "middle")
    need = saved(mid.join(ext, "k").groupBy("c", "m", "b").agg(F.collect_list(F.struct("k", "n", "before")).alias("of")), "need")
    vals = x.join(small(need.select("c", "m", "b"), 500_000), ["c", "m", "b"], "left_semi").groupBy("c", "m", "b", "v").agg(F.count(F.lit(1)).alias("h"))
    vals = vals.join(small(need, 100_000), ["c", "m", "b"]).select("m", "b", "v", "h", F.explode("of").alias("of")).select("of.*", "m", "b", "v", "h")
    vals = vals.groupBy("k", "m", "b", "v").agg(F.sum("h").alias("h"), F.first("n").alias("n"), F.first("before").alias("before"))
    at = F.col("before") + F.sum("h").over(Window.partitionBy("k", "m", "b").orderBy("v"))
    low, high = F.min(F.when(F.col("up") * 2 >= F.col("n"), F.col("v"))), F.min(F.when(F.col("up") * 2 > F.col("n"), F.col("v")))
    name = F.element_at(F.array(*[F.lit(m) for m in q.metrics]), F.col("m") + 1)
    return vals.withColumn("up", at).groupBy("k", "m").agg(F.first("n").alias("n_values"), ((low + high) / 2).alias("local_median")).select("k", name.alias("metric"), "n_values", "local_median")


def _middles(x: DataFrame) -> DataFrame:
    """(m, n, median) of (m, v, b): exact medians of few groups, from a histogram and the values in its middle bins."""
    h = x.groupBy("m", "b").agg(F.count(F.lit(1)).alias("h"))
    w = Window.partitionBy("m")
    up = h.withColumn("up", F.sum("h").over(w.orderBy("b"))).withColumn("n", F.sum("h").over(w))
    below = F.col("up") - F.col("h")
    mid = up.where(((F.col("up") * 2 >= F.col("n")) & (below * 2 < F.col("n"))) | ((F.col("up") * 2 > F.col("n")) & (below * 2 <= F.col("n"))))
    mid = saved(mid.select("m", "b", "n", below.alias("before")), "middle")  # two rows a metric at most
    v = x.join(F.broadcast(mid), ["m", "b"]).groupBy("m", "b", "v").agg(F.count(F.lit(1)).alias("h"), F.first("n").alias("n"), F.first("before").alias("before"))
    v = v.withColumn("up", F.col("before") + F.sum("h").over(Window.partitionBy("m", "b").orderBy("v")))
    low, high = F.min(F.when(F.col("up") * 2 >= F.col("n"), F.col("v"))), F.min(F.when(F.col("up") * 2 > F.col("n"), F.col("v")))
    return v.groupBy("m").agg(F.first("n").alias("n"), ((low + high) / 2).alias("median"))


def global_scale(q: Cube) -> DataFrame:
    """(metric, n, median, mad) over all rows; the MAD falls back to the scaled mean deviation if half the rows tie."""
    edges = _edges(q)
    x = q.rows.select(_binned(q, edges, 32 * BINS)).where("x is not null").select("x.*")
    med = saved(_middles(x), "medians")
    at = {r["m"]: r["median"] for r in med.collect()}  # a row a metric
    of = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("m") + 1)
    far = of([max(edges[m][1] - at.get(i, 0.0), at.get(i, 0.0) - edges[m][0]) or 1.0 for i, m in enumerate(q.metrics)])
    d = x.select("m", F.abs(F.col("v") - of([at.get(i, 0.0) for i in range(len(q.metrics))])).alias("v"), far.alias("far"))
    d = d.select("m", "v", F.least(F.lit(32 * BINS), F.floor(F.col("v") / F.col("far") * 32 * BINS)).cast("int").alias("b"))
    mean = d.groupBy("m").agg(_nine(F.avg("v")).alias("mean_dev"))
    mad = _middles(d).select("m", F.col("median").alias("mad0"))
    name = F.element_at(F.array(*[F.lit(m) for m in q.metrics]), F.col("m") + 1)
    return med.join(mad, "m").join(mean, "m").select(name.alias("metric"), "n", "median", F.when(F.col("mad0") == 0, S.NORMAL / S.MEAN_DEV * F.col("mean_dev")).otherwise(F.col("mad0")).alias("mad"))


def correlation_changes(q: Cube, extents: DataFrame) -> DataFrame:
    """(k, a, b, local, global, delta): correlations of global ranks inside each cohort and over all rows.

    An undefined local correlation is no change. Only sums of each combination are gathered.
    """
    pairs = list(combinations(q.metrics, 2))
    ranked = q.rows
    for m in q.metrics:
        counts = ranked.where(F.col(m).isNotNull()).groupBy(m).agg(F.count(F.lit(1)).alias("_w"))
        ranks = S.running_total(counts, m, "_w", "_up").select(m, (F.col("_up") - F.col("_w") + (F.col("_w") + 1) / 2).alias(f"r_{m}"))
        ranked = ranked.join(small(saved(ranks, "ranks"), 100_000), m, "left")
    half = q.n_rows / 2  # ranks about their middle, so that sums of squares stay exact enough
    sums = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(f"r_{a}").isNotNull() & F.col(f"r_{b}").isNotNull()
        x, y = F.when(both, F.col(f"r_{a}") - half), F.when(both, F.col(f"r_{b}") - half)
        for j, e in enumerate((both.cast("double"), x, y, x * x, y * y, x * y)):
            sums.append(F.sum(e).alias(f"s{i}_{j}"))
    per = saved(ranked.groupBy("c").agg(*sums), "sums")
    total = [F.sum(f"s{i}_{j}").alias(f"s{i}_{j}") for i in range(len(pairs)) for j in range(6)]

    def corr(i: int) -> Column:
        n, x, y, xx, yy, xy = (F.col(f"s{i}_{j}") for j in range(6))
        var = (n * xx - x * x) * (n * yy - y * y)
        return F.when((n > 1) & (var > 0), (n * xy - x * y) / F.sqrt(var))

    items = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), corr(i).alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")
    everywhere = per.agg(*total).select(items).select("x.a", "x.b", F.coalesce("x.r", F.lit(0.0)).alias("global"))
    local = per.join(small(extents.select("k", "c"), 500_000), "c").groupBy("k").agg(*total).select("k", items).select("k", "x.a", "x.b", F.col("x.r").alias("local"))
    return local.join(F.broadcast(everywhere), ["a", "b"]).withColumn("delta", F.coalesce(F.col("global") - F.col("local"), F.lit(0.0)))


def scored(q: Cube, heads: DataFrame, extents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cohorts with scores, their shifts, their correlation changes).

    sd: sum of the three largest |z|; emm: root mean square change of the rank correlations, shrunk
    for few rows; volume: sqrt(p) (1 - p); temp_index: the sum of their z-scores over the cohorts, each at least 0.
    """
    floor, m = max(5 * len(q.metrics), q.n_rows // 200), len(q.metrics)
    g = saved(global_scale(q), "scale")
    z = medians(q, extents).join(F.broadcast(g.select("metric", F.col("median").alias("global_median"), F.col("mad").alias("global_mad"))), "metric")
    z = z.withColumn("z", S.robust_z(F.col("local_median"), F.col("global_median"), F.col("global_mad")))
    shifts = saved(z.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc(F.abs("z")), "metric"))), "shifts")
    sd = shifts.where("r <= 3").groupBy("k").agg(F.sum(F.abs("z")).alias("sd"), F.min_by("metric", "r").alias("metric"), F.min_by("z", "r").alias("effect"))
    change = saved(correlation_changes(q, extents), "changes")
    shrink = F.sqrt(F.greatest(F.lit(0), F.col("n") - floor) / (q.n_rows - floor)) if q.n_rows > floor else F.lit(0.0)
    emm = change.groupBy("k").agg(F.sqrt(2 * F.sum(F.col("delta") * F.col("delta")) / F.lit(float(max(1, m * (m - 1))))).alias("change"))
    p = F.col("n") / F.lit(float(max(1, q.n_rows)))
    x = heads.join(sd, "k").join(emm, "k", "left")
    x = x.withColumn("emm", F.when((F.col("n") >= 3 * m) & F.lit(m >= 2), F.coalesce("change", F.lit(0.0)) * shrink).otherwise(0.0)).withColumn("volume", F.sqrt(p) * (1 - p)).drop("change")
    stats = x.agg(*[f(c).alias(f"{n}_{c}") for c in ("sd", "emm", "volume") for n, f in (("a", F.avg), ("s", F.stddev_pop))])
    part = lambda c: F.greatest(F.lit(0.0), F.coalesce(F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"a_{c}")) / F.col(f"s_{c}")), F.lit(0.0)))
    x = x.crossJoin(F.broadcast(stats)).withColumn("temp_index", F.round(part("sd") + part("emm") + part("volume"), 9)).select(*x.columns, "temp_index")
    return saved(x, "scored"), shifts, change


def pruned(q: Cube, cohorts: DataFrame, extents: DataFrame, near: float = NEAR, most: int = KEPT) -> DataFrame:
    """Adds ``host`` (the kept cohort that absorbs a near duplicate) and ``rank`` (of a kept one): at most ``most`` are kept.

    In order of temp_index, a cohort is absorbed by the first kept one of its metric and sign with a
    Jaccard overlap of at least ``near``. The overlaps are sums over common combinations; only pairs
    that near come to the driver, of at most BUDGET cohorts.
    """
    sign = F.when(F.col("effect") < 0, -1).otherwise(1)
    c = cohorts.withColumn("sign", sign)
    e = extents.join(small(c.select("k", "metric", "sign", F.col("n").alias("rows")), 100_000), "k")
    a, b = e.alias("a"), e.alias("b")
    both = a.join(b, (F.col("a.c") == F.col("b.c")) & (F.col("a.metric") == F.col("b.metric")) & (F.col("a.sign") == F.col("b.sign")) & (F.col("a.k") < F.col("b.k")) & (F.least("a.rows", "b.rows") >= near * F.greatest("a.rows", "b.rows")))
    met = both.groupBy(F.col("a.k").alias("x"), F.col("b.k").alias("y")).agg(F.sum("a.n").alias("i"), F.first("a.rows").alias("rx"), F.first("b.rows").alias("ry"))
    close: dict[int, set[int]] = {}
    for r in met.where(F.col("i") >= near * (F.col("rx") + F.col("ry") - F.col("i"))).select("x", "y").collect():
        close.setdefault(r["x"], set()).add(r["y"])
        close.setdefault(r["y"], set()).add(r["x"])
    kept: list[int] = []
    host: dict[int, int] = {}
    for r in cohorts.select("k", "temp_index", "expression").orderBy(F.desc("temp_index"), "expression").collect():  # at most BUDGET rows
        at = next((x for x in kept if x in close.get(r["k"], ())), None)
        if at is not None:
            host[r["k"]] = at
        elif len(kept) < most:
            kept.append(r["k"])
    rows = [(k, None, i + 1) for i, k in enumerate(kept)] + [(k, x, None) for k, x in host.items()]
    fate = q.combos.sparkSession.createDataFrame(rows, "k bigint, host bigint, rank int")
    return cohorts.join(F.broadcast(fate), "k", "left")


def stability(q: Cube, kept: DataFrame, extents: DataFrame, shifts: DataFrame, reps: int = REPS) -> DataFrame:
    """(k, stability): 1 - min(CV, 0.9) of the sum of a cohort's three largest |z| over ``reps`` resamples.

    A resample draws Poisson weights (by their normal limit, from hashes, so that results don't depend
    on partitions) for the counts of FINE bins of each metric; a resampled median is its bin's middle.
    """
    wide = lambda mad: 5 * (mad or 1.0) / S.NORMAL  # noqa: E731  # five standard deviations, exact, so that bins don't depend on partitions either
    edges = {r["metric"]: (r["global_median"] - wide(r["global_mad"]), r["global_median"] + wide(r["global_mad"])) for r in shifts.select("metric", "global_median", "global_mad").distinct().collect()}  # a row a metric
    edges |= {m: (0.0, 1.0) for m in q.metrics if m not in edges}
    top = shifts.where("r <= 3").select("k", "metric", "global_median", "global_mad").join(F.broadcast(kept.select("k")), "k", "left_semi")
    code = F.create_map(*[x for i, m in enumerate(q.metrics) for x in (F.lit(m), F.lit(i))])
    lo = F.create_map(*[x for m in q.metrics for x in (F.lit(m), F.lit(float(edges[m][0])))])
    step = F.create_map(*[x for m in q.metrics for x in (F.lit(m), F.lit(((edges[m][1] - edges[m][0]) or 1.0) / FINE))])
    mine = saved(extents.select("k", "c").join(F.broadcast(kept.select("k")), "k", "left_semi"), "kept")
    x = q.rows.select("c", _binned(q, edges, FINE)).where("x is not null").groupBy("c", "x.m", "x.b").agg(F.count(F.lit(1)).alias("h"))
    h = x.join(small(mine, 500_000), "c").groupBy("k", "m", "b").agg(F.sum("h").alias("h"))
    h = saved(h.join(F.broadcast(top.withColumn("m", code[F.col("metric")])), ["k", "m"]), "fine")
    u = lambda salt: (F.pmod(F.xxhash64("k", "metric", "b", "rep", F.lit(salt)), F.lit(1_000_003)) + 1) / F.lit(1_000_004.0)
    draw = F.greatest(F.lit(0.0), F.round(F.col("h") + F.sqrt("h") * F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2))))
    d = h.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("w", draw).where("w > 0")
    w = Window.partitionBy("k", "m", "rep")
    d = d.withColumn("up", F.sum("w").over(w.orderBy("b"))).withColumn("all", F.sum("w").over(w)).where(F.col("up") * 2 >= F.col("all"))
    mid = d.groupBy("k", "metric", "rep").agg(F.min("b").alias("b"), F.first("global_median").alias("gm"), F.first("global_mad").alias("gs"))
    value = lo[F.col("metric")] + (F.col("b") + 0.5) * step[F.col("metric")]
    z = mid.withColumn("z", F.abs(S.robust_z(value, F.col("gm"), F.col("gs")))).groupBy("k", "rep").agg(F.sum("z").alias("z"))
    return z.groupBy("k").agg((1 - F.least(F.stddev_pop("z") / (F.avg("z") + 1e-6), F.lit(0.9))).alias("stability"))


def spreads(q: Cube, kept: DataFrame, extents: DataFrame) -> DataFrame:
    """(k, m, mad_local, sd_local) of the primary metric of each kept cohort, from counts of its distinct values."""
    value = F.coalesce(*[F.when(F.col("metric") == m, F.col(m)) for m in q.metrics])
    mine = saved(extents.select("k", "c").join(F.broadcast(kept.select("k", "metric")), "k"), "kept")
    v = q.rows.join(small(mine, 500_000), "c").withColumn("v", value).where("v is not null").groupBy("k", "v").agg(F.count(F.lit(1)).alias("w"))
    v = saved(v, "values")
    n, s, s2 = F.sum("w"), F.sum(F.col("w") * F.col("v")), F.sum(F.col("w") * F.col("v") * F.col("v"))
    base = v.groupBy("k").agg(n.alias("m"), _nine(F.sqrt(F.greatest(F.lit(0.0), (s2 - s * s / n) / (n - 1)))).alias("sd_local"))
    d = v.join(F.broadcast(kept.select("k", "local_median")), "k").withColumn("d", F.abs(F.col("v") - F.col("local_median"))).groupBy("k", "d").agg(F.sum("w").alias("w"))
    w = Window.partitionBy("k")
    d = d.withColumn("up", F.sum("w").over(w.orderBy("d"))).withColumn("all", F.sum("w").over(w))
    low, high = F.min(F.when(F.col("up") * 2 >= F.col("all"), F.col("d"))), F.min(F.when(F.col("up") * 2 > F.col("all"), F.col("d")))
    return base.join(d.groupBy("k").agg(((low + high) / 2).alias("mad_local")), "k")


def confounders(q: Cube, kept: DataFrame, extents: DataFrame) -> DataFrame:
    """(k, dim, js, p, level): dimensions outside a cohort's intent whose levels differ inside it.

    js: Jensen-Shannon distance of the levels inside and over all rows (natural logarithm), above
    DRIVER_JS; p: chi-squared test of inside against the rest (Wilson-Hilferty), below DRIVER_P / dimensions;
    level: the one whose share grows most.
    """
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d), F.lit("nan")).alias("level")) for d in q.dims])).alias("x")
    long = saved(q.combos.select("c", "n", each).select("c", "n", "x.*"), "long")
    everywhere = long.groupBy("dim", "level").agg(F.sum("n").alias("all"))
    mine = small(saved(extents.select("k", "c").join(F.broadcast(kept.select("k")), "k", "left_semi"), "kept"), 500_000)
    inside = long.join(mine, "c").groupBy("k", "dim", "level").agg(F.sum("n").alias("in"))
    x = F.broadcast(kept.select("k", "intent", F.col("n").alias("rows"))).crossJoin(everywhere).join(inside, ["k", "dim", "level"], "left").fillna(0, ["in"])
    x = x.where(~F.col("intent").contains(F.concat("dim", F.lit("=='"))))
    p, r = F.col("in") / F.col("rows"), F.col("all") / F.lit(float(q.n_rows))
    m = (p + r) / 2
    term = lambda a: F.when(a > 0, a * F.log(a / m)).otherwise(0.0)
    expected = lambda total: F.col("all") * total / F.lit(float(q.n_rows))
    out = F.col("rows") * -1 + F.lit(float(q.n_rows))
    chi = F.pow(F.col("in") - expected(F.col("rows")), 2) / expected(F.col("rows")) + F.pow(F.col("all") - F.col("in") - expected(out), 2) / expected(out)
    g = x.groupBy("k", "dim").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(term(p) / 2 + term(r) / 2))).alias("js"), F.sum(chi).alias("chi"), (F.count(F.lit(1)) - 1).alias("df"), F.max(F.struct((p - r).alias("gain"), "level")).getField("level").alias("level"))
    h = 2 / (9 * F.col("df"))
    z = (F.pow(F.col("chi") / F.col("df"), 1 / 3) - (1 - h)) / F.sqrt(h)
    g = g.where("df > 0").withColumn("p", F.when(z >= 0, S.norm_sf(z)).otherwise(1 - S.norm_sf(-z)))
    return g.where((F.col("js") > DRIVER_JS) & (F.col("p") < DRIVER_P / len(q.dims))).select("k", "dim", "js", "p", "level")


def mine(df: DataFrame, dims: list[str], metrics: list[str], most: int = KEPT, min_support: int = 30, min_effect: float = 0.5, alpha: float = 0.05, min_stability: float = 0.5, min_emm: float = 0.08) -> DataFrame:
    """Findings of a table: (expression, intent, kind, metric, n, local_median, global_median, effect,
    p_value, p_adjusted, stability, emm, weight, drivers, n_aliases, reason).

    Every kept cohort is a row, with the one ``reason`` it is refused for, or null. p is adjusted by all
    distinct cohorts times metrics. A cohort whose shift fails but whose correlations change is kept as
    ``covariance``, on the metric of its most changed pair with the larger shift, without the tests of the shift.
    An empty table, or one without a searched conjunction, has no findings.
    """
    q = cube(df, dims, metrics)
    heads, extents = closed_cohorts(q, search_space(q))
    cohorts, shifts, change = scored(q, heads, extents)
    n_tests = cohorts.count() * len(metrics)
    fate = saved(pruned(q, cohorts, extents, most=most), "fate")
    absorbed = fate.where("host is not null").groupBy(F.col("host").alias("k")).agg(F.sum(1 + F.size("aliases")).alias("absorbed"))
    kept = fate.where("rank is not null").join(shifts.select("k", "metric", "n_values", "local_median", "global_median", "global_mad"), ["k", "metric"])
    kept = saved(kept.join(F.broadcast(absorbed), "k", "left").withColumn("n_aliases", F.size("aliases") + F.coalesce("absorbed", F.lit(0))), "kept")
    x = kept.join(stability(q, kept, extents, shifts), "k", "left").join(spreads(q, kept, extents), "k", "left")
    z = S.median_test_z(F.col("local_median"), F.col("global_median"), F.col("mad_local"), F.col("global_mad"), F.col("sd_local"), F.col("m"))
    x = x.withColumn("p_value", S.two_sided(z)).withColumn("p_adjusted", F.least(F.lit(1.0), F.col("p_value") * n_tests))
    pair = change.withColumn("d", F.abs("delta")).groupBy("k").agg(F.max(F.struct("d", F.array("a", "b").alias("p"))).alias("most")).select("k", F.col("most.p").alias("pair"))
    of_pair = shifts.select("k", F.struct(F.abs("z").alias("size"), "metric", "z", "local_median", "global_median").alias("s")).join(pair, "k").where("array_contains(pair, s.metric)").groupBy("k").agg(F.max("s").alias("s"))
    x = x.join(of_pair, "k", "left")
    marginal = (F.abs("effect") >= min_effect) & (F.col("p_adjusted") <= alpha)
    steady = F.coalesce(F.col("stability") >= min_stability, F.lit(False))
    by_shift, by_change = marginal & steady, (F.col("emm") >= min_emm) & F.col("s").isNotNull()
    kind = F.when(~by_shift & by_change, "covariance").otherwise("shift")
    x = x.withColumn("kind", kind).withColumn("reason", F.when(F.col("n") < min_support, "min_support").when(by_shift | by_change, None).when(marginal, "unstable").when(F.abs("effect") >= min_effect, "not_significant").otherwise("weak_effect"))
    covariance = F.col("kind") == "covariance"
    for c, from_pair in (("metric", "s.metric"), ("effect", "s.z"), ("local_median", "s.local_median"), ("global_median", "s.global_median")):
        x = x.withColumn(c, F.when(covariance, F.col(from_pair)).otherwise(F.col(c)))
    for c in ("stability", "p_value", "p_adjusted"):
        x = x.withColumn(c, F.when(~covariance, F.col(c)))
    x = x.withColumn("weight", S.insight_weight(F.col("effect"), F.col("stability"), F.col("volume"), F.col("emm")))
    named = confounders(q, kept, extents).select("k", F.struct(F.lit(0).alias("o"), (-F.col("js")).alias("by"), F.concat(F.lit("["), "dim", F.lit("] heavily skewed to '"), "level", F.lit("' (JS: "), F.format_number("js", 2), F.lit(")")).alias("text")).alias("d"))
    hidden = shifts.where((F.col("r") > 3) & (F.abs("z") > HIDDEN_Z)).select("k", F.struct(F.lit(1).alias("o"), (-F.abs("z")).alias("by"), F.concat(F.lit("["), "metric", F.lit("] hidden shift ("), F.when(F.col("z") >= 0, "+").otherwise(""), F.format_number("z", 1), F.lit(" robust sigma)")).alias("text")).alias("d"))
    drivers = named.unionByName(hidden).groupBy("k").agg(F.slice(F.array_sort(F.collect_list("d")), 1, 3).alias("d")).select("k", F.transform("d", lambda d: d["text"]).alias("drivers"))
    return x.join(drivers, "k", "left").select("expression", "intent", "kind", "metric", "n", "local_median", "global_median", "effect", "p_value", "p_adjusted", *[F.round(c, 9).alias(c) for c in ("stability", "emm", "weight")], F.coalesce("drivers", F.array().cast("array<string>")).alias("drivers"), "n_aliases", "reason")
