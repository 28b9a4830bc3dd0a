import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratum.llm import quantiles as Q


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), max_size=90), min_size=1, max_size=6), st.integers(2, 9))
def test_ranks_stay_within_the_bound(parts, k):
    total, everything = Q.Summary(k), []
    for p in parts:
        s = Q.Summary(k).extend(np.array(p, dtype=float))
        d = s.pack()
        total.merge(Q.Summary.unpack(d["weights"], d["values"], d["err"], d["flip"], k))
        everything += p
    r = total.ranked()
    assert r.n == len(everything)
    for v in range(-1, 52):
        assert abs(r.le(v) - sum(x <= v for x in everything)) <= r.err
        assert abs(r.lt(v) - sum(x < v for x in everything)) <= r.err


def test_error_grows_with_the_logarithm():
    x = np.random.default_rng(0).normal(size=200_000)
    r = Q.Summary(256).extend(x).ranked()
    assert r.err / len(x) < np.log2(len(x) / 256) / 512 * 1.1
    assert abs((x <= r.quantile(0.5)).mean() - 0.5) <= r.err / len(x)


def test_small_summaries_are_exact():
    x = np.array([3.0, 1.0, 2.0, 10.0])
    r = Q.Summary().extend(x).ranked()
    assert [r.quantile(p) for p in (0, 0.25, 0.5, 1)] == [np.quantile(x, p) for p in (0, 0.25, 0.5, 1)]


def tables(spark, n_batches=3, rows=400):
    rng = np.random.default_rng(2)
    dl, pr, ins = [], [], []
    for b in range(n_batches):
        batch, data = f"B{b}", []
        for i in range(rows):
            data.append((i, f"D{b % 2}", batch, None, None, None, None, "s1" if i % 3 else "s2", "web", "van", "no", None, float(rng.normal(50 + b, 9)) if i % 11 else (None if i % 2 else float("nan")), int(rng.integers(0, 9)), float(i % 7), None))
        dl += data + data[:5]
        x = np.array([r[12] for r in dl if r[2] == batch and r[12] is not None and r[12] == r[12]])
        med, mad = float(np.median(x)), float(np.median(np.abs(x - np.median(x))))
        pr.append((f"P{b}", f"D{b % 2}", batch, 1, ["basket"], {"basket": med, "nope": 1.0}, {"basket": mad * (3 if b == 1 else 1)}))
        loc = float(np.median([r[12] for r in dl if r[2] == batch and r[7] == "s2" and r[12] is not None and r[12] == r[12]]))
        sh = lambda lm, gm: [("basket", 1.0, lm, gm, mad, "e"), ("rating", 1.0, 3.0, None, None, "e")]
        ins += [(f"I{b}", f"D{b % 2}", batch, [("segment", "s2")], sh(loc + (30 if b == 2 else 0), med)), (f"J{b}", f"D{b % 2}", batch, [("segment", "none")], sh(1.0, med + 40))] * 2
    ins.append(("N", "D0", "B0", None, None))
    d0 = np.array([r[12] for r in dl if r[1] == "D0" and r[12] is not None and r[12] == r[12]])
    pr.append(("PD", "D0", None, None, None, {"basket": float(np.median(d0)) - 20}, {"basket": float(np.median(np.abs(d0 - np.median(d0))))}))
    dd = "delivery_id bigint, dataset_id string, batch_id string, lat double, lon double, ordered_at timestamp, received_at timestamp, segment string, channel string, vehicle string, refunded string, area string, basket double, items bigint, wait_min double, rating bigint"
    pp = "profile_id string, dataset_id string, batch_id string, n_rows bigint, numerics array<string>, global_medians map<string,double>, global_mads map<string,double>"
    ii = "id string, dataset_id string, batch_id string, conditions array<struct<attribute:string,value:string>>, shifts array<struct<metric:string,robust_z:double,local_median:double,global_median:double,global_mad:double,source:string>>"
    return spark.createDataFrame(dl, dd), spark.createDataFrame(pr, pp), spark.createDataFrame(ins, ii)


WRONG = {("P1", "basket", "global_mad"), ("I2", "basket", "local_median"), ("J0", "basket", "global_median"), ("J1", "basket", "global_median"), ("J2", "basket", "global_median"), ("PD", "basket", "global_median")}


@pytest.mark.parametrize("k,chunk", [(1024, 500_000), (16, 500_000), (16, 50), (1024, 100)])
def test_wrong_statements(spark, k, chunk):
    got = [tuple(r) for r in Q.wrong_statements(*tables(spark), k=k, chunk=chunk).collect()]
    assert len(got) == len(set(got)) and set(got) == WRONG


@pytest.mark.parametrize("k,chunk", [(1024, 500_000), (16, 40)])
def test_rows_of_no_batch_count_for_their_dataset(spark, k, chunk):
    d, p, i = tables(spark, 2, 60)
    extra = spark.createDataFrame([(9_000 + j, "D0", None, *[None] * 9, 900.0 + j, None, None, None) for j in range(400)], d.schema)
    stated = spark.createDataFrame([("ok", "D0", None, None, None, {"basket": 1080.0}, None), ("no", "D0", None, None, None, {"basket": 50.0}, None)], p.schema)
    got = {tuple(r) for r in Q.wrong_statements(d.unionByName(extra), stated, i.limit(0), k=k, chunk=chunk).collect()}
    assert got == {("no", "basket", "global_median")}


def test_empty_tables(spark):
    a, b, c = tables(spark, 1, 20)
    assert Q.wrong_statements(a.limit(0), b, c).count() == 0
    assert Q.wrong_statements(a, b.limit(0), c.limit(0)).count() == 0


def test_percentiles_per_group(spark):
    long = spark.createDataFrame([("a", float(v)) for v in range(101)] + [("b", None), ("c", float("nan")), (None, 4.0)], "g string, value double")
    got = {(r["g"], r["p"]): r["quantile"] for r in Q.percentiles(long, ["g"], [0.0, 0.5, 1.0]).collect()}
    assert got == {("a", 0.0): 0.0, ("a", 0.5): 50.0, ("a", 1.0): 100.0, (None, 0.0): 4.0, (None, 0.5): 4.0, (None, 1.0): 4.0}
