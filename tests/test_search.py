import random

import pytest
from pyspark.sql import functions as F

from stratum.operators import search

DIMS, METRICS = ["region", "category", "channel", "warehouse"], ["margin", "delay", "share"]


@pytest.fixture(scope="module")
def table(spark):
    """EU laptops have a higher margin and always the same warehouse; phones in the US decouple share from delay."""
    rng, rows = random.Random(4), []
    for k in range(3_000):
        r, c, h = rng.choice(["EU", "US", "APAC"]), rng.choice(["laptops", "phones", "tablets"]), rng.choice(["web", "shop"])
        w = "RTM" if (r, c) == ("EU", "laptops") else rng.choice(["LAX", "SIN"])
        delay = rng.gauss(5, 2)
        share = rng.gauss(5, 2) if (r, c) == ("US", "phones") else delay + rng.gauss(0, 0.3)
        rows.append((r, None if r == "APAC" and k % 50 == 0 else c, h, w, rng.gauss(10, 2) + 6 * ((r, c) == ("EU", "laptops")), delay if k % 40 else float("nan"), share, "x"))
    return spark.createDataFrame(rows, "region string, category string, channel string, warehouse string, margin double, delay double, share double, c string")


def test_planted_cohorts_come_out_once(table):
    got = search.mine(table, DIMS, METRICS).collect()
    kept = [r for r in got if r["reason"] is None]
    assert len({r["intent"] for r in got}) == len(got) <= search.KEPT
    eu = [r for r in kept if r["intent"] == "category=='laptops' AND region=='EU' AND warehouse=='RTM'"]
    assert len(eu) == 1 and eu[0]["kind"] == "shift" and eu[0]["metric"] == "margin" and eu[0]["effect"] > 2 and eu[0]["p_adjusted"] < 1e-6 and eu[0]["n_aliases"] >= 3
    assert any(r["kind"] == "covariance" and "category=='phones'" in r["intent"] and "region=='US'" in r["intent"] and r["p_value"] is None for r in kept)
    assert all(r["reason"] in (None, "min_support", "weak_effect", "not_significant", "unstable") for r in got)


def test_p_is_adjusted_by_all_distinct_cohorts(table):
    q = search.cube(table, DIMS, METRICS)
    heads, _ = search.closed_cohorts(q, search.search_space(q))
    n = heads.count() * len(METRICS)
    for r in search.mine(table, DIMS, METRICS, most=3).collect():
        assert r["p_value"] is None or r["p_adjusted"] == pytest.approx(min(1.0, r["p_value"] * n))


def test_extents_and_pruning_equal_brute_force(table):
    q = search.cube(table, DIMS, METRICS)
    heads, extents = search.closed_cohorts(q, search.search_space(q))
    rows = [r.asDict() for r in table.select(*DIMS).collect()]
    cover = {}
    for r in heads.collect():
        conds = [x.split("==") for x in r["expression"].split(" AND ")]
        cover[r["k"]] = {i for i, x in enumerate(rows) if all(f"'{x[d]}'" == v for d, v in conds)}
        assert len(cover[r["k"]]) == r["n"]
        closed = [f"{d}=='{v.pop()}'" for d in sorted(DIMS) for v in [{rows[i][d] for i in cover[r["k"]]}] if len(v) == 1 and None not in v]
        assert " AND ".join(closed) == r["intent"]
    assert len({frozenset(x) for x in cover.values()}) == len(cover)
    scores, _, _ = search.scored(q, heads, extents)
    want, kept = {}, []
    for r in sorted(scores.collect(), key=lambda r: (-r["temp_index"], r["expression"])):
        me = (r["k"], r["metric"], r["effect"] < 0)
        host = next((k for k in kept if k[1:] == me[1:] and len(cover[k[0]] & cover[me[0]]) >= 0.5 * len(cover[k[0]] | cover[me[0]])), None)
        if host is None and len(kept) < 20:
            kept.append(me)
        want[r["k"]] = (host[0] if host else None, kept.index(me) + 1 if me in kept else None)
    got = {r["k"]: (r["host"], r["rank"]) for r in search.pruned(q, scores, extents, near=0.5, most=20).collect()}
    assert got == want and any(h for h, _ in want.values())


def test_space_within_its_budget_and_mass(table):
    q = search.cube(table, DIMS, METRICS)
    sizes = lambda **o: {(r["size"], r["n"]) for r in search.search_space(q, **o).select("k", "size").distinct().groupBy("size").agg(F.count("k").alias("n")).collect()}
    assert {s for s, _ in sizes()} == {2, 3} and {s for s, _ in sizes(budget=100)} == {2} and sizes(budget=10) == {(2, 10)}
    assert not search.search_space(q, mass=0.5).where("expression like '%channel%' and expression like '%shop%' and expression like '%web%'").count()


def test_empty_table(table):
    assert search.mine(table.limit(0), DIMS, METRICS).count() == 0
