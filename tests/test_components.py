import random

from stratum.operators.components import connected_components


def brute(edges):
    label = {}
    for a, b in edges:
        label.setdefault(a, a)
        label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def check(spark, edges, local_edges):
    df = spark.createDataFrame(edges, "a string, b string")
    got = {r["id"]: r["root"] for r in connected_components(df, local_edges=local_edges).collect()}
    assert got == brute([e for e in edges if None not in e])


def test_local_and_contracted_agree_with_brute_force(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)] + [("n00", "n00"), (None, "n01")]
    check(spark, edges, 1_000_000)
    check(spark, edges, 5)


def test_long_chain_and_hub(spark):
    check(spark, [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(40)] + [("hub", f"s{k}") for k in range(30)], 3)


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0
