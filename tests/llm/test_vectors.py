import numpy as np
import pytest

from stratum.llm import clusters as C
from stratum.llm import neighbours as N

SCHEMA = "id string, enc array<float>, shifts array<struct<metric:string,robust_z:double>>, extra int"


def made(n=900, groups=40, seed=0, noise=0.05):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, 120))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    x = centre[np.arange(n) % groups] + noise * rng.normal(size=(n, 120))
    x[n // 2 : n // 2 + 12] = x[n // 2]  # copies under their own ids
    return (x * rng.uniform(0.1, 50, (n, 1))).astype(np.float32)


def frame(spark, x, metric=lambda k: "m"):
    rows = [(f"i{k:05d}", [float(v) for v in r], [(metric(k), 1.0), ("z", 0.5)], 1) for k, r in enumerate(x)]
    bad = [("bad1", None, None, 1), ("bad2", [0.0] * 120, [("m", 1.0)], 1), ("bad3", [1.0] * 80, [("m", 1.0)], 1), ("bad4", [float("nan")] * 120, [("m", 1.0)], 1), ("bad5", [float("inf")] * 120, [("m", 1.0)], 1), (None, [1.0] * 120, [("m", 1.0)], 1)]
    return spark.createDataFrame(rows + rows[:20] + bad, SCHEMA)


def cosines(x):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return s


def top(s, k):
    return [np.lexsort((np.arange(len(s)), -np.round(r, 9)))[:k] for r in s]


def test_pairs_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 128)
    x = made()
    s = cosines(x)
    want = {tuple(sorted((f"i{a:05d}", f"i{b:05d}"))) for a, o in enumerate(top(s, 5)) for b in o if s[a, b] >= 0.9}
    got = [tuple(r) for r in N.found_pairs(frame(spark, x).select("id", "enc")).collect()]
    assert len(got) == len(set(got))
    assert len(set(got) & want) >= 0.99 * len(want) and len(set(got) - want) <= 0.01 * len(want)


def test_recall_of_asked_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 128)
    x = made(noise=0.12)
    s = cosines(x)
    got = {}
    for r in N.similar(frame(spark, x).select("id", "enc"), 5, asked="cast(substr(id, 2) as int) % 50 = 0", visits=12).collect():
        got.setdefault(int(r["id"][1:]), set()).add(int(r["other"][1:]))
    t = top(s, 5)
    assert set(got) == {a for a in range(len(x)) if a % 50 == 0}
    assert np.mean([len(got[a] & set(t[a].tolist())) / 5 for a in got]) >= 0.9


@pytest.mark.parametrize("depth", [0, 1])
def test_recall_beyond_the_deepest_tree(spark, monkeypatch, depth):
    """Cells far larger than meant, as if the collection were larger than the deepest trees can cut."""
    monkeypatch.setattr(N, "CELL", 128)
    monkeypatch.setattr(N, "MAX_DEPTH", depth)
    x = made(1200, 60, noise=0.09)
    t = top(cosines(x), 5)
    got = {}
    for r in N.similar(frame(spark, x).select("id", "enc"), 5, visits=12).collect():
        got.setdefault(int(r["id"][1:]), set()).add(int(r["other"][1:]))
    assert np.mean([len(got.get(a, set()) & set(t[a].tolist())) / 5 for a in range(len(x))]) >= 0.9


def test_nearly_equal_vectors_keep_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 32)
    monkeypatch.setattr(N, "MAX_DEPTH", 0)
    x = made(500, 1, 2, 1e-4)
    got = {}
    for r in N.similar(frame(spark, x).select("id", "enc"), 5, least=0.9).collect():
        got.setdefault(r["id"], []).append(r["cosine"])
    assert len(got) == 500 and all(len(v) == 5 and min(v) > 0.999 for v in got.values())


def test_small_and_empty(spark):
    x = made(3, 3)
    assert {(r["id"], r["other"]) for r in N.similar(frame(spark, x).select("id", "enc"), 5).collect()} == {(f"i{a:05d}", f"i{b:05d}") for a in range(3) for b in range(3) if a != b}
    assert N.found_pairs(frame(spark, x).select("id", "enc").limit(0)).count() == 0


def truth(x, metric, size=5):
    s = cosines(x)
    lab = list(range(len(x)))

    def find(v):
        while lab[v] != v:
            v = lab[v]
        return v

    for a, b in zip(*np.nonzero(s >= 0.65), strict=True):
        if a < b and metric(a) == metric(b):
            p, q = find(a), find(b)
            lab[max(p, q)] = min(p, q)
    root = [find(v) for v in range(len(x))]
    return {(f"i{v:05d}", f"i{r:05d}") for v, r in enumerate(root) if root.count(r) >= size}


def linked(spark, x, metric, crowded):
    from stratum.operators.components import connected_components

    comp = connected_components(C.links(frame(spark, x, metric), crowded=crowded))
    rows = [(r["id"], r["root"]) for r in comp.collect()]
    n = {}
    for _, r in rows:
        n[r] = n.get(r, 0) + 1
    return {(i, r) for i, r in rows if n[r] >= 5}


@pytest.mark.parametrize("crowded,levels", [(4_096, 3), (40, 3), (40, 0), (4, 1)])
def test_clusters_match_brute_force(spark, monkeypatch, crowded, levels):
    """Crowded buckets that are split, and that are compared in blocks right away."""
    monkeypatch.setattr(C, "LEVELS", levels)
    x, metric = made(400, 50, noise=0.055), lambda k: "a" if k % 3 else "b"
    want, got = truth(x, metric), linked(spark, x, metric, crowded)
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_hot_bucket_of_nearly_equal_vectors(spark):
    """A third of all rows, nearly equal: one group, whatever the limit of a bucket."""
    x = np.concatenate([made(120, 1, 3, 0.01), made(240, 240, 4)])
    want, got = truth(x, lambda k: "m"), linked(spark, x, lambda k: "m", 8)
    assert got == want


def test_described_clusters(spark):
    x = made(200, 10)
    out = C.described_clusters(frame(spark, x)).collect()
    assert sum(r["size"] for r in out) == 200 and all(r["density"] > 0.6 and r["typical"] for r in out)


def test_loose_set_is_split_until_nobody_is_left(spark):
    """A chain of 120 vectors, each near its neighbours alone: more groups than medoids a round."""
    base = np.random.default_rng(1).normal(size=(130, 120))
    x = np.stack([base[k : k + 5].sum(0) for k in range(120)])  # neighbours share four of five parts
    df = frame(spark, x.astype(np.float32))
    out = C.described_clusters(df).collect()
    s = cosines(x)
    assert sum(r["size"] for r in out) == C.found_clusters(df).count() > 100 and len(out) > 20
    for r in out:
        t = [int(i[1:]) for i in r["typical"].split()]
        assert all(s[t[0], b] >= 0.649 for b in t[1:])


def test_no_vectors(spark):
    assert C.found_clusters(frame(spark, made(3, 3)).where("1 = 0")).count() == 0
