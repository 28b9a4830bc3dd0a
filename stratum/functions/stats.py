"""Robust statistics as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.runtime import saved, small

Z_CAP = 10.0
NORMAL = 0.6745  # MAD of the standard normal distribution
MEAN_DEV = 0.7979  # mean absolute deviation of it

# Coefficients of a Chebyshev fit of erfc, with a fractional error below 1.2e-7.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def finite(c: Column) -> Column:
    """NaN as null: a missing number is never the largest one."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def norm_sf(z: Column) -> Column:
    """Upper tail of the standard normal distribution, for z >= 0."""
    x = z / math.sqrt(2)
    t = 1 / (1 + x / 2)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(poly - x * x) / 2


def two_sided(z: Column) -> Column:
    return 2 * norm_sf(F.abs(z))


def robust_z(local: Column, median: Column, mad: Column, cap: float = Z_CAP) -> Column:
    """Signed shift of a median in robust standard deviations; a shift of 0 is 0."""
    z = F.least(F.lit(cap), NORMAL * F.abs(local - median) / (mad + 1e-6))
    return F.when(local < median, -z).otherwise(z)


def global_stats(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys..., n, median, mad): mad falls back to the scaled mean deviation if half the rows tie.

    Exact, from counts of distinct values that are ranged over tasks; nulls and NaN are no values.
    """
    v = long.where(finite(F.col(value)).isNotNull()).groupBy(*keys, finite(F.col(value)).alias(value)).agg(F.count(F.lit(1)).alias("_w"))
    v = saved(v, "values")
    med = saved(ranged_median(v, keys, value, "_w"), "medians")
    d = v.join(med.select(*keys, "median"), keys).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    mean = d.groupBy(*keys).agg((F.sum(F.col("_d") * F.col("_w")) / F.sum("_w")).alias("mean_dev"))
    mad = ranged_median(d.groupBy(*keys, "_d").agg(F.sum("_w").alias("_w")), keys, "_d", "_w").select(*keys, F.col("median").alias("mad0"))
    return med.join(mad, keys).join(mean, keys).select(*keys, "n", "median", F.when(F.col("mad0") == 0, NORMAL / MEAN_DEV * F.col("mean_dev")).otherwise(F.col("mad0")).alias("mad"))


def counted_medians(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys..., n, median): exact medians from counts of distinct values.

    Equal values are combined map-side and a group's values are sorted with spill, so that no group
    has to fit in memory, whatever the number of groups.
    """
    g = long.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    x = g.withColumn("_up", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    low, high = F.min(F.when(F.col("_up") * 2 >= F.col("_n"), F.col(value))), F.min(F.when(F.col("_up") * 2 > F.col("_n"), F.col(value)))
    return x.groupBy(*keys).agg(F.max("_n").alias("n"), ((low + high) / 2).alias("median"))


def median_test_z(local: Column, median: Column, mad_local: Column, mad: Column, sd: Column, n: Column, factor: Column | float = 1.0) -> Column:
    """z of a cohort's median: 1.2533 * 1.4826 * MAD / sqrt(n f), MAD local, else global, else sd."""
    f = F.lit(factor) if isinstance(factor, float) else factor
    n_eff = n * f
    root = F.sqrt(n_eff)
    se = F.when(mad_local > 0, 1.2533 * 1.4826 * mad_local / root).when(mad > 0, 1.2533 * 1.4826 * mad / root).otherwise(sd / root)
    return F.when((n < 2) | (n_eff < 1) | (se == 0) | se.isNull(), F.lit(0.0)).otherwise((local - median) / se)


def benjamini_hochberg(df: DataFrame, p: str, over: list[str], out: str = "q") -> DataFrame:
    """Adjusted p-values within each group; groups are the families of tests, bounded by design."""
    group = Window.partitionBy(*over) if over else Window.partitionBy(F.lit(1))
    m = F.count(p).over(group)
    ranked = df.withColumn("_r", F.row_number().over(group.orderBy(F.col(p)))).withColumn("_raw", F.col(p) * m / F.col("_r"))
    back = group.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(out, F.least(F.lit(1.0), F.min("_raw").over(back))).drop("_r", "_raw")


def running_total(counts: DataFrame, value: str, weight: str, out: str) -> DataFrame:
    """Adds the sum of ``weight`` up to and including each ``value``; values are distinct.

    Values are ranged over tasks; only each task's total comes to the driver, so that no task sees them all.
    """
    ranged = counts.repartitionByRange(value).sortWithinPartitions(value).withColumn("_p", F.spark_partition_id())
    held = saved(ranged, "ranged")
    total, before = 0, {}
    for r in sorted(held.groupBy("_p").agg(F.sum(weight).alias("t")).collect(), key=lambda r: r["_p"]):  # a row for each task
        before[r["_p"]] = total
        total += r["t"]
    if not before:
        return held.drop("_p").withColumn(out, F.lit(0).cast("bigint"))
    at = held.sparkSession.createDataFrame(list(before.items()), f"_p int, _b {dict(counts.dtypes)[weight]}")
    w = Window.partitionBy("_p").orderBy(value)
    return held.join(F.broadcast(at), "_p").withColumn(out, F.col("_b") + F.sum(weight).over(w)).drop("_p", "_b")


def ranged_median(counts: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """(keys..., n, median) of groups of any size, from counts of their distinct values.

    Values are ranged over tasks, by group first, so that no task has to hold a group.
    """
    ranged = saved(counts.repartitionByRange(*keys, value).withColumn("_p", F.spark_partition_id()), "ranged")
    part = ranged.groupBy(*keys, "_p").agg(F.sum(weight).alias("_t"))
    w = Window.partitionBy(*keys)
    before = part.withColumn("_b", F.sum("_t").over(w.orderBy("_p")) - F.col("_t")).withColumn("_n", F.sum("_t").over(w)).drop("_t")  # a row for each task that has some of a group
    x = ranged.join(small(saved(before, "before"), 100_000), [*keys, "_p"])
    x = x.withColumn("_up", F.col("_b") + F.sum(weight).over(Window.partitionBy(*keys, "_p").orderBy(value)))
    low, high = F.min(F.when(F.col("_up") * 2 >= F.col("_n"), F.col(value))), F.min(F.when(F.col("_up") * 2 > F.col("_n"), F.col(value)))
    return x.groupBy(*keys).agg(F.max("_n").alias("n"), ((low + high) / 2).alias("median"))


def average_rank(df: DataFrame, value: str, over: list[str], out: str) -> DataFrame:
    """Ranks with ties at their mean, from counts of distinct values; global ones by :func:`running_total`."""
    counts = df.groupBy(*over, value).agg(F.count(F.lit(1)).alias("_c"))
    if not over:
        ranks = running_total(counts, value, "_c", "_up").withColumn(out, F.col("_up") - F.col("_c") + (F.col("_c") + 1) / 2).drop("_c", "_up")
        return df.join(ranks, value)
    w = Window.partitionBy(*over).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn(out, F.coalesce(F.sum("_c").over(w), F.lit(0)) + (F.col("_c") + 1) / 2).drop("_c")
    return df.join(ranks, [*over, value])


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """(keys..., n_eff, median): the lower value where exactly half the weight lies below; Kish n."""
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    per = df.where(finite(F.col(value)).isNotNull() & (F.col(weight) > 0)).groupBy(*keys, value).agg(F.sum(weight).alias("_w"), F.sum(F.col(weight) * F.col(weight)).alias("_w2"))
    up = per.withColumn("_up", F.sum("_w").over(w)).withColumn("_all", F.sum("_w").over(Window.partitionBy(*keys)))
    return up.groupBy(*keys).agg((F.pow(F.sum("_w"), 2) / F.sum("_w2")).alias("n_eff"), F.min(F.when(F.col("_up") * 2 >= F.col("_all"), F.col(value))).alias("median"))


def entropy(df: DataFrame, columns: list[str]) -> DataFrame:
    """(dim, levels, entropy): bits of each column's distribution, in one pass of grouping sets."""
    counts = level_counts(df, columns)
    w = Window.partitionBy("dim")
    share = counts.withColumn("p", F.col("n") / F.sum("n").over(w))
    return share.groupBy("dim").agg(F.count(F.lit(1)).alias("levels"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def level_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(dim, level, n): rows of each level of each column, from one grouping-sets pass; nulls are no level."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("level")) for c in columns])).alias("x")
    return df.select(pairs).where("x.level is not null").groupBy("x.dim", "x.level").agg(F.count(F.lit(1)).alias("n"))


def z_positive(c: Column) -> Column:
    """Population z over the whole result, below 0 as 0; constant or empty as 0. For bounded tables."""
    w = Window.partitionBy(F.lit(1))
    sd = F.stddev_pop(c).over(w)
    return F.greatest(F.lit(0.0), F.coalesce(F.when(sd > 0, (c - F.avg(c).over(w)) / sd), F.lit(0.0)))


def saturating(x: Column, ref: float) -> Column:
    return 1 - F.exp(-x / ref)


def insight_weight(effect: Column, stability: Column, volume: Column, emm: Column) -> Column:
    """0.05 + 0.95 x the weighted geometric mean of the factors that were measured."""
    factors = [(saturating(F.abs(effect), 1.5), 0.35), (stability, 0.25), (volume / 0.3849, 0.10), (0.5 + 0.5 * saturating(emm, 0.08), 0.10)]
    top, down = F.lit(0.0), F.lit(0.0)
    for f, a in factors:
        top += F.when(f.isNotNull(), a * F.log(F.greatest(f, F.lit(1e-3)))).otherwise(0.0)
        down += F.when(f.isNotNull(), F.lit(a)).otherwise(0.0)
    return 0.05 + 0.95 * F.when(down > 0, F.exp(top / down)).otherwise(0.0)


def effective_n_factor(rho: Column) -> Column:
    r = F.least(F.greatest(rho, F.lit(0.0)), F.lit(0.99))
    return (1 - r) / (1 + r)
