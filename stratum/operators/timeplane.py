"""The time plane: calendar bins, series, smoothing, events, spans, echoes and period scores."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions import stats as S
from stratum.operators.gridseries import period_start


def calendar_bins(rows: DataFrame, time: str, grid: str) -> DataFrame:
    """(period, next, n): every calendar bin from the first to the last row, empty ones with n = 0."""
    p = rows.where(F.col(time).isNotNull()).select(period_start(F.col(time), F.lit(grid)).alias("period")).groupBy("period").agg(F.count(F.lit(1)).alias("n"))
    step = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month", "quarter": "interval 3 months"}[grid]
    ends = p.agg(F.min("period").alias("a"), F.max("period").alias("b")).where("a is not null")
    bins = ends.select(F.explode(F.expr(f"sequence(a, b, {step})")).alias("period"))
    return bins.join(p, "period", "left").select("period", F.expr(f"cast(period + {step} as date)").alias("next"), F.coalesce("n", F.lit(0)).alias("n"))


def auto_grid(rows: DataFrame, time: str) -> DataFrame:
    """(grid, bins, rows_per_bin): for each unit the span between the 1st and 99th percentile and its rows."""
    t = rows.where(F.col(time).isNotNull()).agg(F.percentile(F.unix_timestamp(F.col(time).cast("timestamp")), F.array(F.lit(0.01), F.lit(0.99))).alias("p"), F.count(F.lit(1)).alias("n"))
    days = (F.get("p", 1) - F.get("p", 0)) / 86400
    units = F.array(*[F.struct(F.lit(g).alias("grid"), F.lit(d).alias("days")) for g, d in (("day", 1.0), ("week", 7.0), ("month", 30.4375), ("quarter", 91.3125))])
    x = t.select("n", days.alias("span"), F.explode(units).alias("u")).select("n", "u.grid", F.greatest(F.lit(1.0), F.ceil(F.col("span") / F.col("u.days"))).alias("bins"))
    return x.select("grid", F.col("bins").cast("bigint").alias("bins"), (F.col("n") / F.col("bins")).alias("rows_per_bin"))


def series(rows: DataFrame, pattern: str, time: str, grid: str, value: str, min_rows: int = 30) -> DataFrame:
    """(pattern, period, n, z, se): a pattern's median against the rest of its bin, in units of the reference.

    ``rows``: one row per observation with a pattern column that splits them; the rest of a bin is its
    rows of other patterns. Values of a bin are counted once per distinct value, so that the median of
    the rest comes from cumulated counts. Null where bin, pattern or rest has fewer than ``min_rows``.
    """
    r = rows.select(F.col(pattern).alias("pattern"), period_start(F.col(time), F.lit(grid)).alias("period"), S.finite(F.col(value)).alias("v")).where("v is not null and period is not null")
    ref = S.global_stats(r.select(F.lit("x").alias("k"), F.col("v").alias("value")), ["k"]).select((F.col("mad") / S.NORMAL).alias("scale"))
    mine = r.where("pattern is not null").groupBy("pattern", "period").agg(F.count(F.lit(1)).alias("n"), F.median("v").alias("c"), F.stddev_samp("v").alias("sd"))
    who = mine.select("pattern", "period")
    rest = who.join(r.select("period", F.col("pattern").alias("other"), "v"), "period").where(~F.col("other").eqNullSafe(F.col("pattern"))).groupBy("pattern", "period").agg(F.count(F.lit(1)).alias("rn"), F.median("v").alias("rc"), F.stddev_samp("v").alias("rsd"))
    j = mine.join(rest, ["pattern", "period"], "left").crossJoin(F.broadcast(ref))
    ok = (F.col("n") >= min_rows) & (F.coalesce("rn", F.lit(0)) >= min_rows) & (F.col("scale") > 0)
    se = F.sqrt(F.pow(1.2533 * F.col("sd"), 2) / F.col("n") + F.pow(1.2533 * F.col("rsd"), 2) / F.col("rn")) / F.col("scale")
    return j.select("pattern", "period", "n", F.when(ok, (F.col("c") - F.col("rc")) / F.col("scale")).alias("z"), F.when(ok, se).alias("se"))


def count_series(rows: DataFrame, pattern: str, time: str, grid: str) -> DataFrame:
    """(pattern, period, n, log_ratio): log rate of a pattern against the rest of its bin, a half added."""
    r = rows.where(F.col(time).isNotNull()).select(F.col(pattern).alias("pattern"), period_start(F.col(time), F.lit(grid)).alias("period"))
    g = r.groupBy("pattern", "period").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("period"))
    return g.withColumn("rest", total - F.col("n")).where("pattern is not null").select("pattern", "period", "n", F.log((F.col("n") + 0.5) / (F.col("rest") + 0.5)).alias("log_ratio"))


def core_span(bins: DataFrame, share: float = 0.8) -> DataFrame:
    """(pattern, first, last, bins): shortest run of bins with ``share`` of a pattern's rows, the earliest of equals."""
    w = Window.partitionBy("pattern").orderBy("period")
    x = bins.withColumn("i", F.row_number().over(w)).withColumn("up", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("pattern")))
    lo, hi = x.select("pattern", F.col("i").alias("i0"), F.col("period").alias("first"), (F.col("up") - F.col("n")).alias("before")), x.select("pattern", F.col("i").alias("i1"), F.col("period").alias("last"), "up", "all")
    runs = lo.join(hi, "pattern").where((F.col("i1") >= F.col("i0")) & (F.col("up") - F.col("before") >= share * F.col("all")))  # a pattern has at most 1000 bins
    best = runs.groupBy("pattern").agg(F.min(F.struct((F.col("i1") - F.col("i0")).alias("d"), "i0", "first", "last")).alias("m"))
    return best.select("pattern", "m.first", "m.last", (F.col("m.d") + 1).alias("bins"))


def gaps(bins: DataFrame) -> DataFrame:
    """(pattern, first, last, bins): runs of bins without a measured value (gaps and islands)."""
    w = Window.partitionBy("pattern").orderBy("period")
    x = bins.withColumn("i", F.row_number().over(w)).where("z is null").withColumn("g", F.col("i") - F.row_number().over(w))
    return x.groupBy("pattern", "g").agg(F.min("period").alias("first"), F.max("period").alias("last"), F.count(F.lit(1)).alias("bins")).drop("g")


def rts(y: np.ndarray, r: np.ndarray, q: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Local-level Kalman filter and Rauch-Tung-Striebel smoother; NaN is a missing value."""
    n = len(y)
    seen = np.flatnonzero(~np.isnan(y))
    x, p = np.full(n, np.nan), np.full(n, np.nan)
    if not len(seen):
        return x, p
    x[seen[0]], p[seen[0]] = y[seen[0]], r[seen[0]]
    prior = np.full(n, np.nan)
    for t in range(seen[0] + 1, n):
        prior[t] = p[t - 1] + q
        if np.isnan(y[t]):
            x[t], p[t] = x[t - 1], prior[t]
        else:
            k = prior[t] / (prior[t] + r[t])
            x[t], p[t] = x[t - 1] + k * (y[t] - x[t - 1]), (1 - k) * prior[t]
    for t in range(n - 2, seen[0] - 1, -1):
        c = p[t] / prior[t + 1]
        x[t] += c * (x[t + 1] - x[t])
        p[t] += c * c * (p[t + 1] - prior[t + 1])
    return x, p


def events_of(x: np.ndarray, p: np.ndarray, measured: np.ndarray, alpha: float = 0.05, excess: float = 0.5) -> list[tuple[str, int, float]]:
    """(kind, place, height): peaks and dips that stand out on both sides by ``excess`` and by k errors."""
    t = len(x)
    if t < 3:
        return []
    k, out = NormalDist().inv_cdf(1 - alpha / (t * (t - 1))), []
    for kind, s in (("peak", x), ("dip", -x)):
        i = 1
        while i < t - 1:
            j = i
            while j < t - 1 and s[j + 1] == s[i]:
                j += 1
            if s[i] > s[i - 1] and j < t - 1 and s[i] > s[j + 1]:
                at = (i + j) // 2
                left = np.nanmin(s[: i + 1][max([0, *(np.flatnonzero(s[:i] > s[i]) + 1)]) :])
                higher = np.flatnonzero(s[j + 1 :] > s[i])
                right = np.nanmin(s[j : j + 1 + (higher[0] if len(higher) else t)])
                base_l, base_r = int(np.flatnonzero(s == left)[-1]), int(np.flatnonzero(s == right)[0])
                rise = min(s[at] - left - max(excess, k * math.sqrt(p[at] + p[base_l])), s[at] - right - max(excess, k * math.sqrt(p[at] + p[base_r])))
                if rise >= 0 and measured[at]:
                    out.append((kind, at, float(x[at])))
            i = j + 1
    return sorted(out, key=lambda e: e[1])


def dynamics(ser: DataFrame, q: float = 0.1) -> DataFrame:
    """(pattern, period, z, smoothed, variance, event, trend): one pattern's series per task, at most 1000 bins."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("period")
        y, se = (t[c].combine_chunks().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) for c in ("z", "se"))
        x, p = rts(y, se**2, q)
        mark: list[str | None] = [None] * len(y)
        ok = ~np.isnan(x)
        off = int(np.argmax(ok)) if ok.any() else 0
        for kind, at, _ in events_of(x[off:], p[off:], ~np.isnan(y[off:])) if ok.any() else []:
            mark[at + off] = kind
        seen, trend = np.flatnonzero(~np.isnan(y)), "none"
        if len(seen) > 1:
            a, b = seen[0], seen[-1]
            d = x[b] - x[a]
            if abs(d) >= 0.5 and abs(d) >= NormalDist().inv_cdf(0.975) * math.sqrt(p[a] + p[b]):
                trend = "rising" if d > 0 else "falling"
            else:
                trend = "steady"
        return pa.table({"pattern": t["pattern"], "period": t["period"], "z": t["z"], "smoothed": pa.array(x, from_pandas=True), "variance": pa.array(p, from_pandas=True), "event": pa.array(mark, pa.string()), "trend": pa.array([trend] * len(y))})

    return ser.select("pattern", "period", "z", "se").groupBy("pattern").applyInArrow(run, "pattern string, period date, z double, smoothed double, variance double, event string, trend string")


def echoes(events: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, period, metric, kind, of): events that a broader pattern of the same place has too.

    Broader: its conditions are a strict subset. Of several the one with fewest conditions, most rows, least id.
    """
    e = events.join(patterns.select(F.col("id").alias("pattern"), "conditions", "support"), "pattern")
    a, b = e.alias("a"), e.alias("b")
    sub = (F.size(F.array_except("b.conditions", "a.conditions")) == 0) & (F.size("b.conditions") < F.size("a.conditions"))
    j = a.join(b, (F.col("a.period") == F.col("b.period")) & (F.col("a.metric") == F.col("b.metric")) & (F.col("a.kind") == F.col("b.kind"))).where(sub)
    return j.groupBy("a.pattern", "a.period", "a.metric", "a.kind").agg(F.min(F.struct(F.size("b.conditions").alias("k"), (-F.col("b.support")).alias("s"), F.col("b.pattern").alias("of"))).alias("m")).select("pattern", "period", "metric", "kind", "m.of")


def interval_cover(a0: Column, a1: Column, lo: Column, hi: Column) -> Column:
    """Share of [lo, hi) that [a0, a1) covers, in days."""
    days = lambda x, y: F.greatest(F.lit(0), F.datediff(F.least(x, hi), F.greatest(y, lo)))
    return days(a1, a0) / F.datediff(hi, lo)


def recency(age_days: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0)) / half_life)


def period_label(day: Column, grid: str) -> Column:
    """2031-W05, 2031-03, 2031-Q1 or the day itself; ISO weeks."""
    if grid == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    if grid == "month":
        return F.date_format(day, "yyyy-MM")
    if grid == "quarter":
        return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))
    return F.date_format(day, "yyyy-MM-dd")


def parent_period(day: Column, grid: str) -> Column:
    """The period one unit up: a week belongs to the month of its Thursday."""
    return {"day": F.trunc(day, "WEEK"), "week": F.trunc(F.date_add(day, 3), "MONTH"), "month": F.trunc(day, "QUARTER"), "quarter": F.trunc(day, "YEAR")}[grid]
