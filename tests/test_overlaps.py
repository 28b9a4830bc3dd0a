from collections import defaultdict
from itertools import combinations

from stratum import queries as Q
from stratum.operators import discovery as D

DIMS = ["d", "a", "b"]


def test_overlaps_of_all_conjunctions(spark):
    rows = [(k, f"x{k % 3}" if k % 7 else None, f"y{k % 3 if k % 5 else 1}", f"z{k % 2}") for k in range(200)]
    cover = defaultdict(set)
    for k, a, b, d in rows:
        v = {"a": a, "b": b, "d": d}
        for size in (2, 3):
            for c in combinations(sorted(v), size):
                if all(v[x] for x in c):
                    cover[" AND ".join(f"{x}=='{v[x]}'" for x in c)].add(k)
    want = {(x, y, round(len(cover[x] & cover[y]) / len(cover[x] | cover[y]), 9)) for x in cover for y in cover if x < y and len(cover[x] & cover[y]) >= 0.3 * len(cover[x] | cover[y])}
    df = spark.createDataFrame(rows, "id int, a string, b string, d string")
    got = [(r["a"], r["b"], round(r["jaccard"], 9)) for r in D.conjunction_overlaps(df, "id", DIMS, (2, 3), 0.3).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {(a, b) for a, b, _ in got} == {(r["a"], r["b"]) for r in D.extent_overlaps(D.extents(df, "id", DIMS, (2, 3)), 0.3).collect()}


def test_overlaps_outside_one_dimension(spark):
    sf = "/root/testdata/sf0.001"
    every = {tuple(r) for r in Q.QUERIES["overlapping_extents"](spark, sf).collect()}
    part = {tuple(r) for r in Q.QUERIES["near_duplicate_extents"](spark, sf).collect()}
    assert part == {r for r in every if "l_returnflag" in r[0] and "l_returnflag" in r[1]}
    assert len(every) > len(part)
