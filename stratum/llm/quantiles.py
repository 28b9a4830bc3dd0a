"""Mergeable quantile summaries by deterministic buffer collapsing, and statements held against them."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions.stats import ranged_median
from stratum.runtime import saved, small

K = 1024  # values in a buffer; the rank error of n values is at most log2(n / K) / (2 K) of n
SKETCH = "weights array<bigint>, values array<double>, err bigint, flip int"


def collapse(buffers: list[tuple[int, np.ndarray]], flip: int) -> tuple[int, np.ndarray]:
    """Merge equal-size sorted buffers with weights into one, by evenly spaced positions.

    The weighted merge of c buffers has k * W elements, W the sum of the weights; every W-th of them
    is kept, from an offset that alternates (``flip``) between the two middles of an even W.
    """
    w = np.concatenate([np.full(len(v), weight, dtype=np.int64) for weight, v in buffers])
    x = np.concatenate([v for _, v in buffers])
    order = np.argsort(x, kind="stable")
    total = sum(weight for weight, _ in buffers)
    first = total // 2 + (flip if total % 2 == 0 else 1)
    upto = np.cumsum(w[order])
    at = np.arange(len(buffers[0][1]), dtype=np.int64) * total + max(1, first)
    return total, x[order][np.searchsorted(upto, at)]


class Summary:
    """Buffers of k sorted values by weight, a loose rest of fewer than k, and the rank error so far.

    Two buffers of one weight are collapsed into one of twice the weight as soon as they exist, so
    the buffers are the digits of a binary counter and the tree of collapses has log2(n / k) levels.
    Each collapse to weight W moves a rank by at most (W + 1) // 2; ``err`` is the sum. Below k
    values a summary is exact.
    """

    __slots__ = ("buffers", "err", "flip", "k", "rest")

    def __init__(self, k: int = K):
        self.k, self.buffers, self.rest, self.err, self.flip = k, {}, np.empty(0), 0, 0

    def _add(self, weight: int, values: np.ndarray) -> None:
        while weight in self.buffers:
            pair = [(weight, self.buffers.pop(weight)), (weight, values)]
            self.flip ^= 1
            weight, values = collapse(pair, self.flip)
            self.err += (weight + 1) // 2
        self.buffers[weight] = values

    def extend(self, values: np.ndarray) -> Summary:
        x = np.concatenate([self.rest, values]) if len(self.rest) else values
        full = len(x) // self.k * self.k
        for at in range(0, full, self.k):
            self._add(1, np.sort(x[at : at + self.k]))
        self.rest = np.array(x[full:], dtype=np.float64)
        return self

    def merge(self, other: Summary) -> Summary:
        self.err += other.err
        for weight in sorted(other.buffers):
            self._add(weight, other.buffers[weight])
        return self.extend(other.rest)

    def pack(self) -> dict:
        weights = sorted(self.buffers)
        return {"weights": weights, "values": np.concatenate([*(self.buffers[w] for w in weights), self.rest]), "err": self.err, "flip": self.flip}

    @classmethod
    def unpack(cls, weights, values, err: int, flip: int, k: int = K) -> Summary:
        out = cls(k)
        v = np.asarray(values, dtype=np.float64)
        for n, w in enumerate(weights):
            out.buffers[int(w)] = v[n * k : n * k + k]
        out.rest, out.err, out.flip = v[len(weights) * k :], int(err), int(flip)
        return out

    def ranked(self) -> Ranks:
        parts = [*self.buffers.items(), (1, self.rest)]
        x = np.concatenate([v for _, v in parts])
        w = np.concatenate([np.full(len(v), weight, dtype=np.int64) for weight, v in parts])
        order = np.argsort(x, kind="stable")
        return Ranks(x[order], np.concatenate([[0], np.cumsum(w[order])]), self.err)


class Ranks:
    """Sorted values with cumulated weights: ranks and quantiles, each with its bound ``err``."""

    __slots__ = ("err", "upto", "x")

    def __init__(self, x: np.ndarray, upto: np.ndarray, err: int):
        self.x, self.upto, self.err = x, upto, err

    @property
    def n(self) -> int:
        return int(self.upto[-1])

    def le(self, v: float) -> int:
        return int(self.upto[np.searchsorted(self.x, v, "right")])

    def lt(self, v: float) -> int:
        return int(self.upto[np.searchsorted(self.x, v, "left")])

    def at_rank(self, r: int) -> float:
        """The value of rank r, from 1."""
        return float(self.x[np.searchsorted(self.upto[1:], min(max(r, 1), self.n))])

    def quantile(self, p: float) -> float:
        """As numpy's default, between the two middle values where the rank isn't whole."""
        at = p * (self.n - 1)
        lo = self.at_rank(int(at) + 1)
        hi = self.at_rank(min(self.n, int(at) + 2))
        return lo + (hi - lo) * (at - int(at))


LOW, HIGH = 0.45, 0.55


def _judge(lo_le: float, hi_le: float, lo_lt: float, hi_lt: float, n: int) -> bool | None:
    """Whether a statement is wrong, from bounds of the counts <= and < it; None: not decided."""
    if hi_le < LOW * n or lo_lt > HIGH * n:
        return True
    return False if lo_le >= LOW * n and hi_lt <= HIGH * n else None


def judge_median(r: Ranks, v: float) -> bool | None:
    le, lt = r.le(v), r.lt(v)
    return _judge(le - r.err, le + r.err, lt - r.err, lt + r.err, r.n)


def judge_mad(r: Ranks, v: float) -> bool | None:
    """The same for the distances from the median, by ranks of the values themselves."""
    if v < 0:
        return True  # no distance is below 0
    if r.err == 0 and len(r.x) == r.n:
        d = np.abs(r.x - r.quantile(0.5))
        le, lt = int((d <= v).sum()), int((d < v).sum())
        return _judge(le, le, lt, lt, r.n)
    half, e = (r.n + 1) // 2, r.err
    m1, m2 = r.at_rank(half - e), r.at_rank(half + 1 + e)
    hi_le, lo_le = r.le(m2 + v) - r.lt(m1 - v) + 2 * e, r.le(m1 + v) - r.lt(m2 - v) - 2 * e
    hi_lt, lo_lt = r.lt(m2 + v) - r.le(m1 - v) + 2 * e, r.lt(m1 + v) - r.le(m2 - v) - 2 * e
    return _judge(lo_le, hi_le, lo_lt, hi_lt, r.n)


# --- percentiles per group -----------------------------------------------------------------------


def _packed(keys: list[tuple], sums: list[Summary], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    packs = [s.pack() for s in sums]
    cols = [pa.array([k[i] for k in keys], t) for i, t in enumerate(kinds)]
    cols += [pa.array([p["weights"] for p in packs], pa.list_(pa.int64())), pa.array([p["values"] for p in packs], pa.list_(pa.float64())), pa.array([p["err"] for p in packs], pa.int64()), pa.array([p["flip"] for p in packs], pa.int32())]
    return pa.record_batch(cols, names=[*names, "weights", "values", "err", "flip"])


def _unpacked(t: pa.Table, k: int) -> Iterable[Summary]:
    for w, v, e, f in zip(t["weights"].to_pylist(), t["values"], t["err"].to_pylist(), t["flip"].to_pylist(), strict=True):
        yield Summary.unpack(w, v.values.to_numpy(zero_copy_only=False), e, f, k)


def summaries(long: DataFrame, keys: list[str], value: str = "value", k: int = K) -> DataFrame:
    """(keys..., weights, values, err, flip): one summary for each group of a long table.

    Each input partition summarises its own rows first, so that what is shuffled is at most
    ``k`` * log2(rows / k) values for a group and partition; the summaries of a group are then merged
    in two levels, by a salt of the partition and without it. Nulls and NaN are no values; a group
    without values gives no row. Summaries of separate days or tables merge in the same way.
    """
    schema = {f.name: f.dataType.simpleString() for f in long.schema.fields}
    head = ", ".join(f"{x} {schema[x]}" for x in keys)

    def partial(batches):
        import pandas as pd

        held: dict[tuple, Summary] = {}
        kinds = None
        for b in batches:
            kinds = [b.schema.field(x).type for x in keys]
            frame = pa.Table.from_batches([b]).to_pandas()
            for key, rows in frame.groupby(keys, dropna=False, sort=False)[value]:
                key = tuple(None if isinstance(x, float) and np.isnan(x) or x is pd.NaT else x for x in (key if isinstance(key, tuple) else (key,)))
                v = rows.to_numpy(dtype=np.float64, na_value=np.nan)
                held.setdefault(key, Summary(k)).extend(v[~np.isnan(v)])
            if len(held) > 20_000:  # many small groups: pass them on
                yield _packed(list(held), list(held.values()), keys, kinds)
                held = {}
        if held:
            yield _packed(list(held), list(held.values()), keys, kinds)

    def merged(t: pa.Table) -> pa.Table:
        total = Summary(k)
        for s in _unpacked(t, k):
            total.merge(s)
        return pa.Table.from_batches([_packed([tuple(t[x][0].as_py() for x in keys)], [total], keys, [t.schema.field(x).type for x in keys])])

    parts = long.select(*keys, F.col(value).cast("double").alias(value)).where(f"{value} is not null and not isnan({value})").mapInArrow(partial, f"{head}, {SKETCH}")
    salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    return salted.groupBy(*keys, "salt").applyInArrow(merged, f"{head}, {SKETCH}").groupBy(*keys).applyInArrow(merged, f"{head}, {SKETCH}")


def percentiles(long: DataFrame, keys: list[str], probs: list[float], value: str = "value", k: int = K) -> DataFrame:
    """(keys..., n, rank_error, p, quantile): percentiles of each group; rank_error is a share of n."""
    schema = {f.name: f.dataType.simpleString() for f in long.schema.fields}
    head = ", ".join(f"{x} {schema[x]}" for x in keys)

    def read(batches):
        for b in batches:
            t, rows = pa.Table.from_batches([b]), []
            for i, s in enumerate(_unpacked(t, k)):
                r = s.ranked()
                if r.n:
                    rows += [(i, r.n, r.err / r.n, p, r.quantile(p)) for p in probs]
            at = pa.array([x[0] for x in rows], pa.int64())
            yield pa.record_batch([*(t[x].combine_chunks().take(at) for x in keys), pa.array([x[1] for x in rows], pa.int64()), *(pa.array([x[j] for x in rows], pa.float64()) for j in (2, 3, 4))], names=[*keys, "n", "rank_error", "p", "quantile"])

    return summaries(long, keys, value, k).mapInArrow(read, f"{head}, n bigint, rank_error double, p double, quantile double")


# --- statements about medians --------------------------------------------------------------------

DIMS = ["segment", "channel", "vehicle", "refunded", "area"]
METRICS = ["basket", "items", "wait_min", "rating"]
CHUNK = 500_000  # rows of one batch that a task holds
RECORD = "record_id string, dataset_id string, batch_id string, conds array<struct<attribute:string,value:string>>, stated array<struct<metric:string,field:string,v:double>>"
OUT = f"tag string, record_id string, metric string, field string, v double, dataset_id string, batch_id string, cohort string, {SKETCH}"
OUT_KINDS = [*[pa.string()] * 4, pa.float64(), *[pa.string()] * 3, pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int64(), pa.int32()]
OUT_NAMES = [x.split()[0] for x in OUT.split(", ")]


def records(profiles: DataFrame, insights: DataFrame) -> DataFrame:
    """What is stated: a row for each profile and insight, exact repeats once, nulls left out."""
    fields = [("global_medians", "global_median"), ("global_mads", "global_mad")]
    of_map = [F.expr(f"transform(map_entries(coalesce({c}, map())), e -> struct(e.key as metric, '{f}' as field, cast(e.value as double) as v))") for c, f in fields]
    no_conds = F.expr("cast(array() as array<struct<attribute:string,value:string>>)")
    prof = profiles.select(F.col("profile_id").alias("record_id"), "dataset_id", "batch_id", no_conds.alias("conds"), F.concat(*of_map).alias("stated"))
    three = F.expr("flatten(transform(coalesce(shifts, array()), s -> array(struct(s.metric as metric, 'local_median' as field, s.local_median as v), struct(s.metric as metric, 'global_median' as field, s.global_median as v), struct(s.metric as metric, 'global_mad' as field, s.global_mad as v))))")
    conds = F.expr("array_sort(array_distinct(coalesce(conditions, array())))").cast("array<struct<attribute:string,value:string>>")
    ins = insights.select(F.col("id").alias("record_id"), "dataset_id", "batch_id", conds.alias("conds"), three.alias("stated"))
    kept = "filter(stated, x -> x.v is not null and not isnan(x.v) and x.metric is not null)"
    return prof.unionByName(ins).withColumn("stated", F.expr(kept)).where("size(stated) > 0 and record_id is not null").distinct()


def _values(t: pa.Table) -> tuple[dict[str, dict[str, int]], dict[str, np.ndarray], dict[str, np.ndarray]]:
    names, codes = {}, {}
    for d in DIMS:
        col = t[d].combine_chunks().dictionary_encode()
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        names[d] = {v: i for i, v in enumerate(col.dictionary.to_pylist())}
        codes[d] = col.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    metrics = {m: t[m].combine_chunks().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) for m in METRICS}
    return names, codes, metrics


def _clean(x: np.ndarray) -> np.ndarray:
    return x[~np.isnan(x)]


def _cohort_text(conds) -> str:
    return "" if not conds else "\x1e".join(f"{c['attribute']}\x1f{c['value']}" for c in conds)


def _hold(key, left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """Statements of one batch against its rows, or summaries where there is more than one piece."""
    out: list[tuple] = []
    if left.num_rows:
        names, codes, metrics = _values(left)
        dataset, batch, parts = left["dataset_id"][0].as_py(), left["batch_id"][0].as_py(), left["parts"][0].as_py()
        whole: dict[str, Ranks] = {}

        def emit(cohort: str, m: str, s: Summary) -> None:
            p = s.pack()
            out.append(("summary", None, m, None, None, dataset, batch, cohort, p["weights"], p["values"], p["err"], p["flip"]))

        for m in METRICS:
            s = Summary(k).extend(_clean(metrics[m]))
            whole[m] = s.ranked()
            emit("", m, s)
        by_cohort: dict[str, list] = {}
        for rid, own, conds, stated in zip(*(right[c].to_pylist() for c in ("record_id", "batch_id", "conds", "stated")), strict=True):
            by_cohort.setdefault(_cohort_text(conds), []).append((rid, own, conds, stated))
        for cohort, recs in by_cohort.items():
            local = {x["metric"] for _, _, _, stated in recs for x in stated if x["field"] == "local_median"}
            mine: dict[str, Ranks] = {}
            if local:
                mask = None
                for c in recs[0][2]:
                    d = c["attribute"]
                    hit = codes[d] == names[d].get(c["value"], -2) if d in codes and c["value"] is not None else np.zeros(left.num_rows, dtype=bool)
                    mask = hit if mask is None else mask & hit
                at = slice(None) if mask is None else np.flatnonzero(mask)
                for m in sorted(local):
                    if m in metrics:
                        s = Summary(k).extend(_clean(metrics[m][at]))
                        mine[m] = s.ranked()
                        if cohort and (parts > 1 or any(r[1] is None for r in recs)):
                            emit(cohort, m, s)
            if parts > 1:
                continue
            for rid, own, _, stated in recs:
                if own is None:
                    continue
                for x in stated:
                    r = (mine if x["field"] == "local_median" else whole).get(x["metric"])
                    if r is None or not r.n:
                        continue
                    wrong = (judge_mad if x["field"] == "global_mad" else judge_median)(r, x["v"])
                    if wrong is not False:
                        out.append(("found" if wrong else "open", rid, x["metric"], x["field"], x["v"], dataset, batch, cohort, None, None, None, None))
    cols = list(zip(*out, strict=True)) if out else [[]] * len(OUT_NAMES)
    return pa.table([pa.array(list(c), t) for c, t in zip(cols, OUT_KINDS, strict=True)], names=OUT_NAMES)


def wrong_statements(deliveries: DataFrame, profiles: DataFrame, insights: DataFrame, k: int = K, chunk: int = CHUNK) -> DataFrame:
    """(record_id, metric, field): stated medians and MADs that the rows contradict.

    Rows and statements of a batch meet in one task, in pieces of at most ``chunk`` rows or so if the
    batch is larger. Each piece is summarised per metric and cohort. Statements about a batch of
    one piece are judged there; those about larger batches and whole datasets are judged on merged
    summaries. A statement within the summary's error of a limit is counted exactly
    (:func:`_count_open`). Rows repeated count each time. Null or NaN statements, metrics that are no
    column and groups without values give no case; repeated records count once.
    """
    rec = records(profiles, insights)
    at = F.coalesce("batch_id", F.concat(F.lit("\u0000"), F.coalesce("dataset_id", F.lit(""))))  # rows of no batch count for their dataset
    rows = deliveries.select("dataset_id", "batch_id", *DIMS, *METRICS).withColumn("at", at)
    counts = saved(rows.groupBy(F.col("at").alias("batch_id")).agg(F.count(F.lit(1)).alias("n"), F.min("dataset_id").alias("dataset_id")), "counts")
    big = counts.where(F.col("n") > chunk).select("batch_id", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
    one = rec.where("batch_id is not null")
    # records of a whole dataset that have conditions need a summary from each of its batches
    scoped = rec.where("batch_id is null and size(conds) > 0")
    each = scoped.join(counts.select("dataset_id", F.col("batch_id").alias("at")), "dataset_id").select("record_id", "dataset_id", "batch_id", "conds", "stated", "at")
    asked = one.withColumn("at", F.col("batch_id")).unionByName(each)
    if big.isEmpty():
        rows, asked = rows.withColumn("parts", F.lit(1)).withColumn("part", F.lit(0)), asked.withColumn("part", F.lit(0))
    else:
        big = small(big, 100_000)
        rows = rows.withColumn("row", F.monotonically_increasing_id()).join(big.withColumnRenamed("batch_id", "at"), "at", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("row")
        asked = asked.join(big.withColumnRenamed("batch_id", "at"), "at", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("parts")

    held = rows.groupBy("at", "part").cogroup(asked.groupBy("at", "part")).applyInArrow(lambda key, left, right: _hold(key, left, right, k), OUT)
    held = saved(held, "held")
    return _judged(held, rec, deliveries, big, k)


def _judged(held: DataFrame, rec: DataFrame, deliveries: DataFrame, big: DataFrame, k: int) -> DataFrame:
    said = rec.withColumn("x", F.explode("stated")).select("record_id", "dataset_id", "batch_id", "conds", F.col("x.metric").alias("metric"), F.col("x.field").alias("field"), F.col("x.v").alias("v"))
    text = F.expr("array_join(transform(conds, c -> concat(c.attribute, '\\u001f', c.value)), '\\u001e')")
    cohort = F.when(F.col("field") == "local_median", text).otherwise(F.lit(""))
    wide = said.where("batch_id is null").select("record_id", "metric", "field", "v", F.concat(F.lit("D"), "dataset_id").alias("scope"), cohort.alias("cohort"), "dataset_id", "batch_id")
    large = said.join(big.select("batch_id"), "batch_id").select("record_id", "metric", "field", "v", F.concat(F.lit("B"), "batch_id").alias("scope"), cohort.alias("cohort"), "dataset_id", "batch_id")
    asked = wide.unionByName(large)
    parts = held.where("tag = 'summary'").select("dataset_id", "batch_id", "cohort", "metric", "weights", "values", "err", "flip")
    both = parts.withColumn("scope", F.concat(F.lit("D"), "dataset_id")).unionByName(parts.join(big.select("batch_id"), "batch_id", "left_semi").withColumn("scope", F.concat(F.lit("B"), "batch_id")))
    both = both.join(asked.select("scope", "cohort", "metric").distinct(), ["scope", "cohort", "metric"], "left_semi")
    head = "scope string, cohort string, metric string"
    keys = ["scope", "cohort", "metric"]

    def merged(t: pa.Table) -> pa.Table:
        total = Summary(k)
        for s in _unpacked(t, k):
            total.merge(s)
        return pa.Table.from_batches([_packed([tuple(t[x][0].as_py() for x in keys)], [total], keys, [pa.string()] * 3)])

    # two levels: a group of many batches is merged by 64 tasks before one
    first = both.withColumn("salt", F.pmod(F.xxhash64("batch_id"), F.lit(64))).groupBy(*keys, "salt").applyInArrow(merged, f"{head}, {SKETCH}")

    def judge(key, left: pa.Table, right: pa.Table) -> pa.Table:
        total = Summary(k)
        for s in _unpacked(left, k):
            total.merge(s)
        out, r = [], total.ranked()
        if r.n:
            for row in right.to_pylist():
                wrong = (judge_mad if row["field"] == "global_mad" else judge_median)(r, row["v"])
                if wrong is not False:
                    out.append(("found" if wrong else "open", *(row[c] for c in ("record_id", "metric", "field", "v", "dataset_id", "batch_id", "cohort"))))
        cols = list(zip(*out, strict=True)) if out else [[]] * 8
        return pa.table([pa.array(list(c), t) for c, t in zip(cols, OUT_KINDS[:8], strict=True)], names=OUT_NAMES[:8])

    late = first.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(judge, ", ".join(OUT.split(", ")[:8]))
    verdicts = saved(held.where("tag <> 'summary'").select(*OUT_NAMES[:8]).unionByName(late), "verdicts")
    found = verdicts.where("tag = 'found'").select("record_id", "metric", "field")
    still = verdicts.where("tag = 'open'")
    if not still.isEmpty():
        found = found.unionByName(_count_open(still, deliveries))
    return found.distinct()


def _count_open(still: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Exact counts for the statements that a summary's error leaves open, from their rows alone.

    ``still``: (record_id, metric, field, v, dataset_id, batch_id or null, cohort). Each stated value
    costs two sums; only a MAD also needs the exact median, from counts of distinct values that are
    ranged over tasks.
    """
    u = still.select("record_id", "metric", "field", "v", "dataset_id", "batch_id", "cohort").distinct()
    u = saved(u.withColumn("uid", F.xxhash64("record_id", "metric", "field", "v", "batch_id")), "open")
    long = deliveries.select("dataset_id", "batch_id", F.create_map(*[x for c in DIMS for x in (F.lit(c), F.col(c))]).alias("dims"), F.explode(F.create_map(*[x for c in METRICS for x in (F.lit(c), F.col(c).cast("double"))])).alias("metric", "x")).where("x is not null and not isnan(x)")
    conds = F.when((F.col("field") != "local_median") | (F.col("cohort") == ""), F.expr("cast(array() as array<string>)")).otherwise(F.split("cohort", "\x1e"))
    q = small(u.withColumn("conds", conds), 20_000)
    met = F.expr("forall(conds, c -> dims[split(c, '\\u001f')[0]] <=> split(c, '\\u001f')[1])")
    l, r = long.alias("l"), q.alias("q")
    xs = l.join(r.where("batch_id is not null"), (F.col("l.batch_id") == F.col("q.batch_id")) & (F.col("l.metric") == F.col("q.metric"))).where(met).select("uid", "record_id", "q.metric", "field", "v", "x")
    xs = xs.unionByName(l.join(r.where("batch_id is null"), (F.col("l.dataset_id") == F.col("q.dataset_id")) & (F.col("l.metric") == F.col("q.metric"))).where(met).select("uid", "record_id", "q.metric", "field", "v", "x"))
    w = xs.groupBy("uid", "record_id", "metric", "field", "v", "x").agg(F.count(F.lit(1)).alias("w"))
    w = saved(w, "counted")
    mid = ranged_median(w.where("field = 'global_mad'").select("uid", "x", "w"), ["uid"], "x", "w").select("uid", F.col("median").alias("mid"))
    d = w.join(mid, "uid", "left").withColumn("y", F.when(F.col("field") == "global_mad", F.abs(F.col("x") - F.col("mid"))).otherwise(F.col("x")))
    s = d.groupBy("uid", "record_id", "metric", "field").agg(F.sum("w").alias("n"), F.sum(F.when(F.col("y") <= F.col("v"), F.col("w")).otherwise(0)).alias("le"), F.sum(F.when(F.col("y") < F.col("v"), F.col("w")).otherwise(0)).alias("lt"))
    return s.where((F.col("le") < LOW * F.col("n")) | (F.col("lt") > HIGH * F.col("n"))).select("record_id", "metric", "field")
