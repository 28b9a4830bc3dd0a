from datetime import datetime, timedelta

from stratum.operators import gridseries as G


def frames(spark, rows, ds):
    return spark.createDataFrame(rows, "source_id bigint, dataset_id string, metric string, read_at timestamp, arrived_at timestamp, value double"), spark.createDataFrame(ds, "dataset_id string, grid string, tz string")


def test_gaps_marks_and_exact_cells(spark):
    t0 = datetime(2024, 1, 1, 12)
    rows = []
    for s in range(8):
        for k in range(20):
            if (k + s) % 5 != 0 or k in (0, 19):
                rows.append((s, "a", "m", t0 + timedelta(days=k), None, float(10 * s + k % 3)))
    rows += [rows[0], (0, "a", "m", None, None, 1.0), (0, "a", "m", t0 + timedelta(days=50), None, float("nan")), (0, "a", "m", t0 + timedelta(days=60), None, float("inf"))]
    rows += [(99, "a", "m", t0, None, 1.0), (99, "a", "m", t0 + timedelta(days=3), None, 2.0), (5, "zz", "m", t0, None, 1.0)]
    r, ds = frames(spark, rows, [("a", "day", None)])
    out = {(x["source_id"], str(x["period"])): x for x in G.regular_series(r, ds).collect()}
    assert len(out) == 8 * 20 + 4
    assert out[0, "2024-01-02"]["status"] == "observed" and out[0, "2024-01-02"]["value"] == 1.0
    gap = out[0, "2024-01-06"]
    assert gap["status"] == "filled" and abs(gap["value"] - 2.0) < 3 and gap["n"] == 0
    assert out[99, "2024-01-02"]["status"] == "unsupported" and out[99, "2024-01-02"]["value"] is None
    miss = {(x["source_id"], x["period"]) for x in G.missing_periods(r, ds).collect()}
    assert miss == {k for k, v in out.items() if v["status"] != "observed"}


def test_zone_weeks_and_quarters(spark):
    rows = [(1, "w", "m", datetime(2024, 1, 1, 3), None, 1.0), (1, "w", "m", datetime(2024, 1, 20), None, 1.0), (2, "q", "m", datetime(2023, 12, 31, 23), None, 1.0), (2, "q", "m", datetime(2024, 9, 1), None, 1.0)]
    r, ds = frames(spark, rows, [("w", "week", "America/Chicago"), ("q", "quarter", "Europe/Berlin")])
    got = {(x["source_id"], x["period"]) for x in G.missing_periods(r, ds).collect()}
    assert got == {(1, "2024-01-01"), (1, "2024-01-08"), (2, "2024-04-01")}


def test_empty(spark):
    r, ds = frames(spark, [], [])
    assert G.missing_periods(r, ds).count() == 0


def test_session_zone_has_no_part(spark):
    from stratum.operators import gridseries as G

    r = spark.sql("select 's' as source_id, 'd' as dataset_id, timestamp '2024-03-01 23:30:00Z' + make_interval(0, 0, 0, x) as read_at, 1.0D as value from values (0), (3) as t(x)")
    d = spark.createDataFrame([("d", "day", "Europe/Berlin")], "dataset_id string, grid string, tz string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert sorted(str(x["period"]) for x in G.observed_cells(r, d).collect()) == ["2024-03-02", "2024-03-05"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
