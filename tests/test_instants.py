import random
from datetime import UTC, datetime
from itertools import product

import pyarrow as pa
import pytest

from stratum.operators import instants as I
from tests import instants_by_hand as H

CASES = [
    ("2024-03-10 02:30", "America/Chicago", "2024-03-10T08:00:00"),  # no such time: the next that is
    ("2024-11-03 01:30", "America/Chicago", "2024-11-03T06:30:00"),  # twice: the first
    ("2024-01-01", "Asia/Kolkata", "2023-12-31T18:30:00"),
    ("2024-01-01T10:00:00+05:45[Asia/Kathmandu]", "UTC", "2024-01-01T04:15:00"),
    ("2024-01-01 10:00:00 Europe/Berlin", "UTC", "2024-01-01T09:00:00"),
    ("Mon, 1 Jan 2024 10:00:00 −0330", None, "2024-01-01T13:30:00"),
    ("1704103200", "Asia/Tokyo", "2024-01-01T10:00:00"),
    ("1704103200123", None, "2024-01-01T10:00:00.123"),
    ("20240101T100000Z", "Asia/Tokyo", "2024-01-01T10:00:00"),
    ("2024-01-01T10:00:00.123456789", None, "2024-01-01T10:00:00.123456"),
    (" Jan 5, 2024 12:05 AM\r", None, "2024-01-05T00:05:00"),
    ("01.02.2024 03:04:05", None, "2024-02-01T03:04:05"),
    ("2024-10-06 02:15", "Australia/Lord_Howe", "2024-10-05T15:30:00"),  # a half-hour gap
]


def read(text, tz):
    got = I.interpretations(pa.array([text], pa.string()), pa.array([tz], pa.string())).to_pylist()[0]
    return [(r["format"], r["utc_us"]) for r in got]


@pytest.mark.parametrize("text,tz,want", CASES)
def test_one_reading(text, tz, want):
    us = int(datetime.fromisoformat(want).replace(tzinfo=UTC).timestamp() * 1e6 + 0.5)
    assert [u for _, u in read(text, tz)] == [us]


@pytest.mark.parametrize("text", [None, "", "  ", "soon", "2024-02-30", "2024-13-01 08:00", "45321", "1e9", "12:40", "2024-W", "31/31/2024 10:00", "2024-01-01T25:00:00", "x" * 100_000, "２０２４-01-01"])
def test_no_reading(text):
    assert read(text, "UTC") == [] and H.interpretations(text, "UTC") == []


def test_digits_beyond_microseconds():
    assert read("2024-01-01T00:00:00." + "123456789" * 20, None) == [("iso", 1704067200123456)]


def test_columns_read_as_single_texts():
    rng = random.Random(2)
    zones = [None, "Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "No/Zone", "UTC"]
    clock = ["", " {h}:{mi}", "T{h}:{mi}:{s}", " {h}:{mi}:{s}.{f}", ", {h}:{mi} pm", "t{h}:{mi}:{s},{f} AM"]
    tail = ["", "Z", " UTC", "+05:30", " -0330", "+5", " GMT+2", "−0800", "+530", "+1630", "[Asia/Tokyo]", " Europe/Kyiv", " europe/kyiv", "Z[Europe/Paris]"]
    date = ["{y}-{m}-{d}", "{y}/{m}/{d}", "{y}.{m}.{d}", "{m}/{d}/{y}", "{d}.{m}.{y}", "{d}-{mon}-{y}", "Tue, {d} {mon} {y}", "{mon} {d}th, {y}", "{y}{mm}{dd}", "thurs {mon} {d} 10:11:12 UTC {y}", "{n}"]
    texts, tzs = [], []
    for _ in range(4_000):
        v = {"y": rng.choice([1969, 1999, 2024, 2024, 9999, 0]), "m": rng.randrange(0, 14), "d": rng.randrange(0, 33), "h": rng.randrange(0, 26), "mi": f"{rng.randrange(62):02}", "s": f"{rng.randrange(62):02}", "f": str(rng.randrange(10 ** rng.randrange(1, 12))), "mon": rng.choice(["Jan", "sept", "MARCH", "feb", "Mai"])}
        v |= {"mm": f"{v['m']:02}", "dd": f"{v['d']:02}", "n": str(rng.randrange(10 ** rng.randrange(1, 18)))}
        texts.append((rng.choice(date) + rng.choice(clock) + rng.choice(tail)).format(**v) if rng.random() > 0.02 else rng.choice([" ", "ſun 1 jan 2024", "", None, "٣"]))
        tzs.append(rng.choice(zones))
    got = I.interpretations(pa.array(texts), pa.array(tzs)).to_pylist()
    for t, z, g in zip(texts, tzs, got, strict=True):
        assert [(r["format"], r["utc_us"]) for r in g] == H.interpretations(t, z), (t, z)
    assert sum(map(bool, got)) > 500


def test_orders_by_majority_and_extra_columns(spark):
    rows = [(1, "a", "13/01/2024 00:00", 0), (2, "a", "02/03/2024 00:00", 0), (2, "a", "02/03/2024 00:00", 0), (3, "b", "01/13/2024 00:00", 0), (4, "b", "02/03/2024 00:00", 0), (5, "b", "14/01/2024", 0), (6, "b", "03/25/2024", 0), (7, None, "2024-01-01", 0), (8, "b", None, 0)]
    raw = spark.createDataFrame(rows, "row_id bigint, dataset_id string, when_text string, tz int")
    ds = spark.createDataFrame([("a", None), ("b", "UTC")], "dataset_id string, tz string")
    got = {r["row_id"]: datetime.fromtimestamp(r["utc_us"] / 1e6, UTC).strftime("%Y-%m-%d") for r in I.normalised(raw, ds).collect()}
    assert got == {1: "2024-01-13", 2: "2024-03-02", 3: "2024-01-13", 4: "2024-02-03", 6: "2024-03-25", 7: "2024-01-01"}


def test_empty(spark):
    raw, ds = spark.createDataFrame([], "row_id bigint, dataset_id string, when_text string"), spark.createDataFrame([], "dataset_id string, tz string")
    assert I.normalised(raw, ds).count() == 0


@pytest.mark.parametrize("switch", [None, 3])
def test_viterbi_in_pieces_is_the_best_path(spark, switch):
    rng = random.Random(5)
    cells = []
    for k in range(9):
        a, b = rng.randrange(5), rng.randrange(5)
        cells.append((k, a if rng.random() > 0.3 else None, b if rng.random() > 0.3 else None))
    cells = [c for c in cells if c[1] is not None or c[2] is not None]
    rows = [("d", k, [{"format": f, "utc_us": u} for f, u in (("slash_dmy", a), ("slash_mdy", b)) if u is not None]) for k, a, b in cells]
    table = spark.createDataFrame(rows, "dataset_id string, row_id bigint, readings array<struct<format:string,utc_us:bigint>>")
    got = [I.SLASH.index(r["format"]) for r in I.slash_order(table, switch=switch, pieces=3).orderBy("row_id").collect()]

    def cost(path):
        us = [c[1 + s] for c, s in zip(cells, path, strict=True)]
        total = sum(I.INVALID for u in us if u is None)
        for i in range(1, len(path)):
            if path[i] != path[i - 1]:
                total += I.INF if switch is None else switch
            if us[i] is not None and us[i - 1] is not None and us[i] < us[i - 1]:
                total += 1
        return total

    assert cost(got) == min(cost(p) for p in product((0, 1), repeat=len(cells)))
