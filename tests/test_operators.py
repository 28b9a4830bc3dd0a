import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.functions import stats as S
from stratum.operators import anchors, discovery, graph, lattice, spatial, timeplane
from stratum.plans import pipeline
from stratum.sources import exports, files
from stratum.sources.store import Store


def test_normal_tail_and_bh(spark):
    z = [0.0, 0.5, 1.0, 1.96, 3.0, 6.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(S.norm_sf(F.col("z"))).collect()]
    assert all(abs(a / (0.5 * math.erfc(x / math.sqrt(2))) - 1) < 2e-7 for a, x in zip(got, z, strict=True))
    p = [0.001, 0.04, 0.03, 0.5]
    q = {r["p"]: r["q"] for r in S.benjamini_hochberg(spark.createDataFrame([(x,) for x in p], "p double"), "p", []).collect()}
    assert q[0.001] == pytest.approx(0.004) and q[0.03] == pytest.approx(0.04 * 4 / 3) and q[0.5] == 0.5


def test_medians_with_ties_nulls_and_nan(spark):
    rows = [("a", float(v)) for v in (1, 2, 2, 3, 10)] + [("a", None), ("a", float("nan")), ("b", 5.0), ("b", 5.0), ("b", 5.0), ("b", 9.0)]
    df = spark.createDataFrame(rows, "k string, value double")
    got = {r["k"]: (r["n"], r["median"], round(r["mad"], 6)) for r in S.global_stats(df, ["k"]).collect()}
    assert got == {"a": (5, 2.0, 1.0), "b": (4, 5.0, round(S.NORMAL / S.MEAN_DEV, 6))}
    c = {r["k"]: r["median"] for r in S.counted_medians(df.where("value is not null and not isnan(value)"), ["k"]).collect()}
    assert c == {"a": 2.0, "b": 5.0}
    w = S.weighted_median(spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 3.0, 2.0)], "k string, value double, w double"), ["k"], "value", "w").first()
    assert w["median"] == 2.0 and w["n_eff"] == pytest.approx(16 / 6)


def test_average_ranks(spark):
    df = spark.createDataFrame([(float(v),) for v in (5, 1, 5, 9)], "v double")
    assert sorted(r["r"] for r in S.average_rank(df, "v", [], "r").collect()) == [1.0, 2.5, 2.5, 4.0]


def test_planted_effects_are_found(spark):
    t = files.retail_table(spark, 4000)
    o = pipeline.Options()
    f = pipeline.findings(t, "order_id", o).collect()
    kept = {r["expression"]: r for r in f if r["reason"] is None}
    assert "category=='laptops' AND region=='EU'" in kept and "category=='phones' AND region=='US'" in kept
    us = kept["category=='phones' AND region=='US'"]
    assert us["metric"] == "discount" and us["effect"] > 1 and us["p_adjusted"] < 1e-6 and 0 < us["weight"] <= 1
    again = {r["expression"]: tuple(r) for r in pipeline.findings(t.repartition(7), "order_id", o).collect()}
    assert again == {r["expression"]: tuple(r) for r in f}


def test_empty_table_is_refused(spark):
    with pytest.raises(files.IngestionError):
        pipeline.findings(spark.createDataFrame([], "id bigint, a string"), "id", pipeline.Options())


def test_identical_extents(spark):
    rows = [(k, "x" if k < 3 else "y", "p" if k < 3 else "q", "s") for k in range(6)]
    df = spark.createDataFrame(rows, "row_id bigint, a string, b string, c string")
    got = {(r["n"], r["members"]) for r in discovery.identical_extents(discovery.extents(df, "row_id", ["a", "b", "c"])).collect()}
    assert got == {(3, 3)}


def test_cells_rings_parents(spark):
    rng = np.random.default_rng(2)
    pts = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.uniform(-80, 80, 400), rng.uniform(-170, 170, 400), strict=True)] + [(float("nan"), 0.0), (None, 1.0), (95.0, 0.0)], "lat double, lon double")
    c = pts.withColumn("cell", spatial.cell_of(F.col("lat"), F.col("lon"), 5))
    assert c.where("cell is null").count() == 3
    c = c.where("cell is not null")
    la, lo = spatial.centre(F.col("cell"))
    far = c.select(F.max(F.sqrt((la - F.col("lat")) ** 2 + (lo - F.col("lon")) ** 2))).first()[0]
    assert far <= spatial.edge(5) * (1 + 1e-9)
    assert c.select((spatial.cell_of(la, lo, 5) == F.col("cell")).alias("ok")).where("not ok").count() == 0
    assert c.select(F.size(F.array_distinct(spatial.disk(F.col("cell"), 2))).alias("n")).distinct().collect()[0][0] == 19
    g = spatial.neighbour_graph(c.select("cell").distinct())
    assert g.join(g.select(F.col("nbr").alias("cell"), F.col("cell").alias("nbr")), ["cell", "nbr"], "left_anti").count() == 0
    assert exports.cells_geojson(c.select("cell").distinct(), "cell", ["cell"]).first()[0].startswith('{"type":"Feature"')


def test_moran_and_deal(spark):
    cells = [(f"4:{q}:{r}", float(q > 2), f"b{q // 3}") for q in range(6) for r in range(6)]
    df = spark.createDataFrame(cells, "cell string, v double, block string")
    g = spatial.neighbour_graph(df)
    assert spatial.moran_i(df, g, "v").first()["moran"] > 0.5
    lisa = {r["quadrant"] for r in spatial.local_moran(df, g, "v").collect()}
    assert {"HH", "LL"} <= lisa
    d = spatial.dealt(df, "block", "v", 3)
    assert d.groupBy("block").agg(F.sum("v").alias("s")).join(df.groupBy("block").agg(F.sum("v").alias("t")), "block").where("s <> t").count() == 0


def test_smoother_and_events():
    y = np.array([0, 0, 0, 5, 5, 0, np.nan, 0, 0, 0.0])
    x, p = timeplane.rts(y, np.full(10, 0.01))
    assert np.all(np.isfinite(x)) and abs(x[3] - 5) < 0.5 and p[6] > p[5]
    ev = timeplane.events_of(x, p, ~np.isnan(y))
    assert [e[0] for e in ev] == ["peak"] and ev[0][1] in (3, 4)
    assert timeplane.events_of(np.zeros(10), np.full(10, 0.01), np.ones(10, bool)) == []
    assert np.isnan(timeplane.rts(np.full(3, np.nan), np.ones(3))[0]).all()


def test_lattice_small(spark):
    c = lambda **k: [{"attribute": a, "value": v} for a, v in k.items()]
    s = lambda z: [{"metric": "m", "robust_z": z, "local_median": 1.0, "global_median": 0.0, "global_mad": 1.0, "source": "e"}]
    kind = "id string, batch_id string, dataset_id string, conditions array<struct<attribute:string,value:string>>, shifts array<struct<metric:string,robust_z:double,local_median:double,global_median:double,global_mad:double,source:string>>, support bigint, weight double"
    rows = [("p1", "b", "d", c(a="1"), s(2.0), 9, 0.5), ("p2", "b", "d", c(a="1", b="2"), s(1.0), 5, 0.5), ("p3", "b", "d", c(a="1", b="2", c="3"), s(-1.0), 3, 0.5), ("p4", "b", "d", c(a="1", b="9"), s(-3.0), 3, 0.5), ("p4", "b", "d", c(a="1", b="9"), s(-3.0), 3, 0.5), ("p5", "b", "d", [], None, 3, None), (None, "b", "d", None, None, 1, None)]
    sc = lattice.scopes(spark.createDataFrame(rows, kind))
    spec = {(r["child"], r["parent"]) for r in lattice.specialisations(sc).collect()}
    assert spec == {("p2", "p1"), ("p3", "p2"), ("p4", "p1"), ("p1", "p5")}
    sib = lattice.siblings(sc)
    assert [(r["a"], r["b"]) for r in sib.collect()] == [("p2", "p4")]
    con = lattice.contrasts(sib.select("a", "b"), sc).first()
    assert (con["metric"], con["strength"]) == ("m", 1.0)


def test_anchors_learn_batches():
    rng = np.random.default_rng(1)
    base = np.linalg.qr(rng.normal(size=(30, 3)))[0].T
    state = anchors.AnchorState()
    for b in range(3):
        x = np.repeat(base, 8, axis=0) + 0.03 * rng.normal(size=(24, 30))
        act = anchors.learn(state, f"b{b}", [f"p{b}-{k}" for k in range(24)], x, np.ones(24))
        assert {a[0] for a in act} == {f"p{b}-{k}" for k in range(24)}
    assert len(state.centroid) == 3 and np.allclose(np.linalg.norm(state.centroid, axis=1), 1) and (state.mass > 0).all()
    assert anchors.learn(state, "b0", ["x"], base[:1], np.ones(1)) == []
    assert anchors.sphere(base).shape == (3, 3)


def test_finding_without_strength_links_no_anchors(spark):
    """Shifts of 0 are activations of strength 0: alone in a finding (p2) they share nothing, beside others (p3) they change nothing."""
    act = [("p1", "A", 0.9), ("p1", "B", 0.6), ("p2", "A", 0.0), ("p2", "B", 0.0), ("p2", "C", 0.0), ("p3", "A", 0.5), ("p3", "B", 0.3), ("p3", "C", 0.0)]
    got = {(r["a"], r["b"]): round(r["weight"], 9) for r in anchors.co_occurrences(spark.createDataFrame(act, "id string, anchor string, strength double")).collect()}
    assert got == {("A", "B"): round((0.9 * 0.6 / 1.5) ** 2 + (0.5 * 0.3 / 0.8) ** 2, 9)}


def test_answer_with_a_finding_of_zero_shifts(spark):
    """transversal_walk at 0.1 GB failed by a division by 0 at the first such finding."""
    c = lambda **k: [{"attribute": a, "value": v} for a, v in k.items()]
    s = lambda *z: [{"metric": m, "robust_z": x, "local_median": 1.0, "global_median": 0.0, "global_mad": 1.0, "source": "e"} for m, x in zip(("wait_min", "items"), z, strict=True)]
    kind = "id string, batch_id string, dataset_id string, conditions array<struct<attribute:string,value:string>>, target string, shifts array<struct<metric:string,robust_z:double,local_median:double,global_median:double,global_mad:double,source:string>>, support bigint, weight double"
    rows = [("p1", "b", "d", c(segment="business"), "wait_min", s(4.0, 2.0), 9, 0.5), ("p2", "b2", "d", c(area="1"), "items", s(2.0, 3.0), 5, 0.5), ("p3", "b2", "d", c(area="2"), "items", s(0.0, 0.0), 5, 0.5)]
    i = spark.createDataFrame(rows, kind)
    act = i.select("id", F.explode("shifts").alias("s")).select("id", F.col("s.metric").alias("anchor"), (F.col("s.robust_z") / 5).alias("strength"))
    got = {r["node"]: (round(r["score"], 9), r["route"]) for r in pipeline.answer(i, act, "wait_min", "segment", "business", 1).collect()}
    seed = 0.35 + 0.25 + 0.15 + 0.05
    assert got == {"p1": (round(seed, 9), "seed"), "p2": (round(seed * 0.8 * 0.4 * 0.5, 9), "transversal"), "p3": (0.0, "transversal")}


def test_walk_is_best_product_of_three_phases(spark):
    """Structural, then anchors, then structural; siblings aren't walked and no path returns to a seed."""
    e = spark.createDataFrame([("a", "A", "ACTIVATES", 0.9), ("b", "A", "ACTIVATES", 0.5), ("b", "B", "ACTIVATES", 0.8), ("c", "B", "ACTIVATES", 1.0), ("a", "d", "SPECIALIZES", 1.0), ("d", "c", "SIBLING", 1.0), ("d", "f", "CONTRASTS", 0.5), ("A", "B", "CO_OCCURS", 0.6), ("c", "g", "CO_LOCATED", 0.5), ("g", "h", "SPECIALIZES", 1.0)], "source string, target string, type string, weight double")
    w = spark.createDataFrame([(x, 0.5 if x == "c" else 1.0) for x in "abcdfgh"], "id string, weight double")
    got = {r["node"]: (round(r["score"], 6), r["route"]) for r in graph.walk(e, spark.createDataFrame([("a", 1.0)], "node string, score double"), w).collect()}
    by_b = 0.9 * 0.6 * 0.8
    assert got == {"a": (1.0, "seed"), "d": (0.85, "structural"), "b": (round(max(0.45, by_b), 6), "transversal"), "c": (round(0.9 * 0.6 * 0.5, 6), "transversal"), "g": (round(0.9 * 0.6 * 0.85 * 0.5, 6), "transversal")}
    far = {r["node"]: r["distance"] for r in graph.closure(e, spark.createDataFrame([("a",)], "node string"), 2).collect()}
    assert far == {"a": 0, "A": 1, "d": 1, "b": 2, "c": 2, "B": 2, "f": 2}


def test_text_tables(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("﻿lat;lon;when;code\n41.5;-87.5;2024-03-01;1\n;;x;2\n", encoding="utf-8")
    df = files.read_table(spark, str(p))
    assert df.columns == ["lat", "lon", "when", "code"] and df.count() == 2
    lat, lon = files.locate_points(df)
    assert df.select(lat, lon).first()[:] == (41.5, -87.5)
    assert [r["code"] for r in files.apply_categories(df, ["code"]).collect()] == ["1", "2"]
    assert files.dataset_fingerprint("d", {"a": 1, "b": None}) == files.dataset_fingerprint("d", {"a": 1})
    assert files.content_digest(spark, str(p)) == files.content_digest(spark, str(p))
    assert files.parse_metadata("Source: the desk\n of the city\nGrid: week") == {"source": "the desk of the city", "grid": "week"}
    with pytest.raises(files.IngestionError):
        files.filter_rows(df, "nope=1")
    with pytest.raises(files.IngestionError):
        files.select_present(["zz"], df)


def test_bands_tie_and_missing(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 1, 1, 2, 3)] + [(None,), (float("nan"),)], "v double")
    got = {r["v_band"]: r["count"] for r in files.apply_bins(df, {"v": 4}).groupBy("v_band").count().collect()}
    assert got["missing"] == 2 and sum(got.values()) == 8


def test_points_from_text(spark):
    df = spark.createDataFrame([("POINT (-87.5 41.5)",), ('{"type":"Point","coordinates":[10, 20.5]}',), ("POINT (10 95)",), ("junk",), (None,)], "t string")
    lat, lon = files.parse_points(F.col("t"))
    assert [tuple(r) for r in df.select(lat.alias("a"), lon.alias("b")).collect()] == [(41.5, -87.5), (20.5, 10.0), (None, None), (None, None), (None, None)]


def test_store_commits_once_and_drops(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    df = spark.range(3)
    assert s.read("t") is None and s.commit("b1", {"t": df}) and not s.commit("b1", {"t": df}) and s.commit("b2", {"t": df})
    assert s.read("t").count() == 6 and s.drop({"b1"}) == 1 and s.read("t").count() == 3 and s.sweep() == 1
    assert statistics.mean(r["id"] for r in s.read("t").collect()) == 1


def test_rows_csv_and_text_vectors(spark, tmp_path):
    from stratum.sources import exports

    df = spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "row_id bigint, cell string, v double")
    exports.rows_csv(df.coalesce(1), str(tmp_path / "rows"), ["cell"])
    assert sorted(spark.read.option("header", True).csv(str(tmp_path / "rows")).collect()) == [("1", "a"), ("2", None)]
    v = {r["k"]: np.array(r["v"]) for r in anchors.hashed_text_vectors(spark.createDataFrame([(1, "late vans"), (2, "Late Vans"), (3, None), (4, "rain")], "k int, t string"), "k", "t").collect()}
    assert np.allclose(v[1], v[2]) and not v[3].any() and abs(np.linalg.norm(v[4]) - 1) < 1e-9 and v[1] @ v[4] < 0.5
