import numpy as np

from stratum.llm import clusters as C

SCHEMA = "id string, enc array<float>, shifts array<struct<metric:string,robust_z:double>>"


def stars(cosine, n=5, seed=0):
    """A vector for each cosine's centre and n - 1 others that have that cosine to it alone."""
    rng, out = np.random.default_rng(seed), []
    for c in cosine:
        q, _ = np.linalg.qr(rng.normal(size=(120, n)))
        out += [q[:, 0], *(c * q[:, 0] + np.sqrt(1 - c * c) * q[:, k] for k in range(1, n))]
    return np.array(out)


def found(spark, x, metric=lambda k: "m"):
    rows = [(f"i{k:05d}", [float(v) for v in r], [(metric(k), 1.0)]) for k, r in enumerate(x)]
    return {tuple(r) for r in C.found_clusters(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_no_link_near_the_limit_is_left_out(spark, monkeypatch):
    """A star of five is a cluster only if all four of its links are found."""
    monkeypatch.setattr(C, "BLOCK", 64)
    limits = [0.655] * 100 + [0.65002] * 20 + [0.64998] * 20
    got = found(spark, stars(limits))
    assert got == {(f"i{5 * g + k:05d}", f"i{5 * g:05d}") for g, c in enumerate(limits) for k in range(5) if c > 0.65}


def test_links_stay_within_a_metric(spark):
    assert found(spark, stars([0.9] * 6), lambda k: "m" if k % 5 else "other") == set()


def test_rounding_bounds_the_error_of_a_cosine():
    """Vectors of one large component are rounded by more than six standard deviations of the others' error."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 120)) * 0.01
    x[:, 0] = 1
    x[200:] = rng.normal(size=(200, 120))
    u = C.V.units(x)
    for bits in (C.BITS, C.FINE):
        y = C.V.floats(C.V.blobs(C.V.fixed_point(u, bits)[0]), bits, 120)
        e = C.errors(y, bits)
        assert (np.abs(y.astype(np.float64) @ y.T - u @ u.T) <= e[:, None] + e).all()
