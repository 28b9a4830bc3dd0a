"""Single steps of the cohort search: profile, dimensions, levels, slices, overlaps; :mod:`search` is the whole."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions import stats as S
from stratum.operators import search
from stratum.runtime import saved, small

TOP_DIMS, MASS, KEPT, EXTENT_JACCARD = 6, 0.95, 50, 0.88


def profile_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_rows, n_values, n_distinct, top_share, role): one wide aggregate, exact counts.

    Roles: ``identifier`` (all values distinct, no float), ``constant``, ``metric`` (numeric), else ``dimension``.
    """
    kinds = dict(df.dtypes)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    per = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    agg = per.groupBy("column").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("n_values"), F.count("v").alias("n_distinct"), F.max(F.when(F.col("v").isNotNull(), F.col("n"))).alias("top"))
    floats, numeric = [c for c in columns if kinds[c] in ("double", "float")], [c for c in columns if kinds[c] in ("double", "float", "bigint", "int", "smallint", "tinyint") or kinds[c].startswith("decimal")]
    role = F.when((F.col("n_distinct") == F.col("n_values")) & (F.col("n_values") > 1) & ~F.col("column").isin(floats), "identifier").when(F.col("n_distinct") <= 1, "constant").when(F.col("column").isin(numeric), "metric").otherwise("dimension")
    return agg.select("column", "n_rows", "n_values", "n_distinct", F.round(F.col("top") / F.col("n_values"), 6).alias("top_share"), role.alias("role"))


def nested_dimensions(df: DataFrame, dims: list[str]) -> DataFrame:
    """(a, b, pairs, nested): distinct level pairs; nested if at most 1.10 x the larger level count."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in combinations(sorted(dims), 2)]
    d = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("x is not null and y is not null").distinct()
    g = d.groupBy("a", "b").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("x").alias("nx"), F.countDistinct("y").alias("ny"))
    return g.select("a", "b", "pairs", (F.col("pairs") <= 1.10 * F.greatest("nx", "ny")).alias("nested"))


def correlated_metrics(df: DataFrame, metrics: list[str], limit: float = 0.95) -> DataFrame:
    """(a, b, r, colinear) for each pair of metrics, from one aggregate."""
    pairs = list(combinations(metrics, 2))
    row = df.agg(*[F.corr(S.finite(F.col(a)), S.finite(F.col(b))).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("r")) for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(items).alias("x")).select("x.*", (F.abs(F.col("x.r")) > limit).alias("colinear"))


def long_form(df: DataFrame, dims: list[str], metrics: list[str]) -> DataFrame:
    """(dims..., metric, value): metrics unpivoted, missing values left out."""
    x = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), S.finite(F.col(m)).alias("value")) for m in metrics])).alias("x")
    return df.select(*dims, x).select(*dims, "x.metric", "x.value").where("value is not null")


def dimension_power(df: DataFrame, dims: list[str], metrics: list[str]) -> DataFrame:
    """(dim, power): mean over metrics of epsilon squared of a one-way layout, from one pass of sums."""
    items = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("level"), F.lit(m).alias("metric"), S.finite(F.col(m)).alias("y")) for d in dims for m in metrics])).alias("x")
    g = df.select(items).select("x.*").where("level is not null and y is not null").groupBy("dim", "metric", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("s2"))
    t = g.groupBy("dim", "metric").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("s").alias("s"), F.sum("s2").alias("s2"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"))
    t = t.withColumn("sst", F.col("s2") - F.col("s") * F.col("s") / F.col("n")).withColumn("ssb", F.col("between") - F.col("s") * F.col("s") / F.col("n"))
    msw = (F.col("sst") - F.col("ssb")) / (F.col("n") - F.col("k"))
    e = F.when((F.col("sst") > 0) & (F.col("n") > F.col("k")), F.greatest(F.lit(0.0), F.col("ssb") - (F.col("k") - 1) * msw) / F.col("sst")).otherwise(0.0)
    return t.withColumn("e", e).groupBy("dim").agg(F.avg("e").alias("power"))


def chosen_dimensions(power: DataFrame, most: int = TOP_DIMS, least: int = 3) -> DataFrame:
    """Dimensions above the median power, at most ``most``, filled up to ``least``."""
    med = power.agg(F.median("power").alias("mid"))
    r = power.crossJoin(F.broadcast(med)).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("power"), "dim")))
    return r.where(((F.col("power") > F.col("mid")) & (F.col("rank") <= most)) | (F.col("rank") <= least)).select("dim", "power", "rank")


def levels_to_mass(counts: DataFrame, mass: float = MASS) -> DataFrame:
    """Levels of each dimension by share, up to and including the one that crosses ``mass``."""
    w = Window.partitionBy("dim").orderBy(F.desc("n"), "level")
    total = F.sum("n").over(Window.partitionBy("dim"))
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.where(~F.col("level").isin("nan", "<NA>", "None")).withColumn("share", F.col("n") / total).withColumn("before", before / total).where(F.col("before") < mass).drop("before")


def conjunctions(df: DataFrame, dims: list[str], metrics: list[str], sizes: tuple[int, ...] = (2,), min_rows: int = 1) -> DataFrame:
    """(expression, metric, n, local_median): all conjunctions of ``sizes`` conditions on distinct dimensions."""
    return search.all_conjunctions(df, dims, metrics, sizes, min_rows)


def slices(df: DataFrame, dims: list[str], metrics: list[str], sizes: tuple[int, ...] = (2,)) -> DataFrame:
    """(expression, n, sd, volume, primary_metric, primary_z): screened conjunctions with their three largest shifts.

    n_min = max(5 metrics, floor(N / 200)); a conjunction that holds all rows is none.
    """
    n_rows = df.count()
    floor = max(5 * len(metrics), n_rows // 200)
    per = conjunctions(df, dims, metrics, sizes, floor).where(F.col("n") < n_rows)
    g = S.global_stats(long_form(df, [], metrics), ["metric"]).select("metric", "median", "mad")
    z = per.join(F.broadcast(g), "metric").withColumn("z", S.robust_z(F.col("local_median"), F.col("median"), F.col("mad")))
    top = z.withColumn("r", F.row_number().over(Window.partitionBy("expression").orderBy(F.desc(F.abs("z")), "metric"))).where("r <= 3")
    agg = top.groupBy("expression").agg(F.max("n").alias("n"), F.sum(F.abs("z")).alias("sd"), F.min_by("metric", "r").alias("primary_metric"), F.min_by("z", "r").alias("primary_z"))
    p = F.col("n") / F.lit(float(n_rows))
    return agg.withColumn("volume", F.sqrt(p) * (1 - p))


def ranked_slices(sl: DataFrame, most: int = KEPT) -> DataFrame:
    """temp_index = positive z of SD plus that of the volume; the best ``most``."""
    x = sl.withColumn("temp_index", S.z_positive(F.col("sd")) + S.z_positive(F.col("volume")))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("temp_index"), "expression"))).where(F.col("rank") <= most)


def extents(df: DataFrame, row_id: str, dims: list[str], sizes: tuple[int, ...] = (2,)) -> DataFrame:
    """(expression, row_id): the cover of each conjunction, long form."""
    conj = [F.concat_ws(" AND ", *[F.concat(F.lit(f"{d}=='"), F.col(d).cast("string"), F.lit("'")) for d in c]) for k in sizes for c in combinations(sorted(dims), k)]
    ok = [F.when(sum((F.col(d).isNull().cast("int") for d in c), F.lit(0)) == 0, e) for (c, e) in zip([c for k in sizes for c in combinations(sorted(dims), k)], conj, strict=True)]
    return df.select(F.col(row_id).alias("row_id"), F.explode(F.array(*ok)).alias("expression")).where("expression is not null")


def identical_extents(cover: DataFrame) -> DataFrame:
    """(extent, n, head, members): conjunctions with the same rows, by an order-free hash of their row ids.

    The hash adds up two 64-bit hashes of each id, so that no list of rows is built.
    """
    h = cover.groupBy("expression").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("row_id").cast("decimal(20,0)")).alias("h1"), F.sum(F.xxhash64("row_id", F.lit(1)).cast("decimal(20,0)")).alias("h2"))
    size = F.size(F.split("expression", " AND "))
    return h.groupBy("n", "h1", "h2").agg(F.min(F.struct((-size).alias("s"), "expression")).alias("m"), F.count(F.lit(1)).alias("members")).select("n", F.col("m.expression").alias("head"), "members")


def extent_overlaps(cover: DataFrame, least: float = EXTENT_JACCARD) -> DataFrame:
    """(a, b, jaccard) of conjunctions whose rows overlap by at least ``least``; for covers of kept cohorts."""
    n = cover.groupBy("expression").agg(F.count(F.lit(1)).alias("n"))
    both = cover.alias("x").join(cover.alias("y"), (F.col("x.row_id") == F.col("y.row_id")) & (F.col("x.expression") < F.col("y.expression"))).groupBy(F.col("x.expression").alias("a"), F.col("y.expression").alias("b")).agg(F.count(F.lit(1)).alias("i"))
    j = both.join(n.select(F.col("expression").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("expression").alias("b"), F.col("n").alias("nb")), "b")
    return j.select("a", "b", (F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("jaccard")).where(F.col("jaccard") >= least)


def conjunction_overlaps(df: DataFrame, row_id: str, dims: list[str], sizes: tuple[int, ...] = (2,), least: float = EXTENT_JACCARD) -> DataFrame:
    """(a, b, jaccard) as :func:`extent_overlaps` has them for the covers of all conjunctions of ``sizes`` conditions.

    Rows with the same levels are in the same conjunctions, so ids are joined with one combination of
    levels a row, and pairs of conjunctions are built from distinct pairs of combinations, weighted by
    their rows; no cover is joined with itself.
    """
    text = [F.when(sum((F.col(d).isNull().cast("int") for d in c), F.lit(0)) == 0, F.concat_ws(" AND ", *[F.concat(F.lit(f"{d}=='"), F.col(d).cast("string"), F.lit("'")) for d in c])) for k in sizes for c in combinations(sorted(dims), k)]
    combo = F.xxhash64(F.to_json(F.struct(*dims), {"ignoreNullFields": "false"}))
    per = saved(df.groupBy(F.col(row_id).alias("id"), *dims).agg(F.count(F.lit(1)).alias("k")).select("id", combo.alias("c"), "k", *dims), "combos")
    names = saved(per.groupBy("c", *dims).agg(F.sum("k").alias("k")).select("c", "k", F.array_compact(F.array(*text)).alias("held")), "names")
    n = names.select("k", F.explode("held").alias("e")).groupBy("e").agg(F.sum("k").alias("n"))
    x, y = per.select("id", F.col("c").alias("cx"), F.col("k").alias("kx")), per.select("id", F.col("c").alias("cy"), F.col("k").alias("ky"))
    met = x.join(y, "id").groupBy("cx", "cy").agg(F.sum(F.col("kx") * F.col("ky")).alias("i"))
    held = small(names, 100_000)
    met = met.join(held.select(F.col("c").alias("cx"), F.col("held").alias("hx")), "cx").join(held.select(F.col("c").alias("cy"), F.col("held").alias("hy")), "cy")
    both = met.select("i", "hy", F.explode("hx").alias("a")).select("i", "a", F.explode("hy").alias("b")).where("a < b").groupBy("a", "b").agg(F.sum("i").alias("i"))
    j = both.join(n.select(F.col("e").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("e").alias("b"), F.col("n").alias("nb")), "b")
    return j.select("a", "b", (F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("jaccard")).where(F.col("jaccard") >= least)


def correlation_change(df: DataFrame, dim: str, metrics: list[str]) -> DataFrame:
    """(level, a, b, local, global, delta): Spearman correlations of a level on global average ranks."""
    d = df
    for m in metrics:
        d = S.average_rank(d.where(S.finite(F.col(m)).isNotNull()), m, [], f"r_{m}")
    pairs = list(combinations(metrics, 2))
    cols = [F.corr(f"r_{a}", f"r_{b}").alias(f"c{k}") for k, (a, b) in enumerate(pairs)]
    loc, glo = d.where(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("level")).agg(*cols), d.agg(*[c.alias(f"g{k}") for k, c in enumerate(cols)])
    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("local"), F.col(f"g{k}").alias("global")) for k, (a, b) in enumerate(pairs)])
    return loc.crossJoin(F.broadcast(glo)).select("level", F.explode(items).alias("x")).select("level", "x.*", F.coalesce(F.col("x.global") - F.col("x.local"), F.lit(0.0)).alias("delta"))


def drivers(df: DataFrame, inside: F.Column, dims: list[str]) -> DataFrame:
    """(dim, js, level, gain): Jensen-Shannon distance of each dimension inside and outside a cohort.

    ``level`` is the one whose share gains most inside.
    """
    long = df.select(inside.alias("inside"), F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("level")) for c in dims])).alias("x")).select("inside", "x.*").where("level is not null")
    c = long.groupBy("dim", "level").agg(F.sum(F.col("inside").cast("int")).alias("a"), F.sum((~F.col("inside")).cast("int")).alias("b"))
    w = Window.partitionBy("dim")
    p = c.withColumn("p", F.col("a") / F.sum("a").over(w)).withColumn("q", F.col("b") / F.sum("b").over(w)).withColumn("m", (F.col("p") + F.col("q")) / 2)
    term = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / F.col("m"))).otherwise(0.0)
    return p.groupBy("dim").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(term("p") / 2 + term("q") / 2))).alias("js"), F.max_by("level", F.struct(F.col("p") - F.col("q"), F.col("level"))).alias("level"), F.max(F.col("p") - F.col("q")).alias("gain"))


def admit(c: DataFrame, floor: float = 0.2, budget: int = 200, batch: str = "batch_id") -> DataFrame:
    """Adds ``reason`` and ``rank`` to weighted insights: ``low_weight`` below the floor, ``budget`` beyond it."""
    ok = F.col("weight") >= floor
    rank = F.row_number().over(Window.partitionBy(batch, ok).orderBy(F.desc("weight"), "id"))
    return c.withColumn("rank", F.when(ok, rank)).withColumn("reason", F.when(~ok, "low_weight").when(F.col("rank") > budget, "budget"))
