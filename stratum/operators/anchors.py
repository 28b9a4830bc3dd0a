"""Latent anchors: vectors of findings, assignment, learning from batches, links between anchors."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW, HIGH, FEW = 0.88, 0.92, 10  # adaptive threshold: its limits, and anchors below which it is LOW
SECOND = 0.8  # share of the best cosine that a second anchor needs
SOFT_MERGE, FLOOR = 0.95, 0.20
MAX_ANCHORS = 80


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(v: Column) -> Column:
    """A vector at unit length, zero as zero; its norm is worked out once, in an array of one."""
    once = F.array(F.struct(v.alias("v"), F.sqrt(dot(v, v)).alias("n")))
    return F.get(F.transform(once, lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x.cast("double") / s["n"]).otherwise(0.0))), F.lit(0))


def _scaled(v: Column, by: float) -> Column:
    return F.transform(v, lambda x: x * by)


def compose(scope: Column, target: Column, phenomenon: Column, weights: tuple[float, float, float] = (0.45, 0.55, 1.0)) -> Column:
    """Unit composite of three unit blocks."""
    return l2(F.concat(*[_scaled(l2(b), w) for b, w in zip((scope, target, phenomenon), weights, strict=True)]))


def similarities(vectors: DataFrame, anchors: DataFrame) -> DataFrame:
    """(id, anchor, cosine) of every vector with every anchor; anchors are at most MAX_ANCHORS or so rows."""
    return vectors.crossJoin(F.broadcast(anchors)).select("id", "anchor", (dot(F.col("v"), F.col("c")) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("c"), F.col("c")))).alias("cosine"))


def adaptive_threshold(anchors: DataFrame) -> DataFrame:
    """(tau): LOW below FEW anchors, else the 85th percentile of their cosines, within LOW and HIGH."""
    a, b = anchors.alias("a"), anchors.alias("b")
    cos = a.join(b, F.col("a.anchor") < F.col("b.anchor")).select((dot(F.col("a.c"), F.col("b.c")) / F.sqrt(dot(F.col("a.c"), F.col("a.c")) * dot(F.col("b.c"), F.col("b.c")))).alias("cosine"))
    n = anchors.agg(F.count(F.lit(1)).alias("n"))
    return cos.agg(F.percentile("cosine", F.lit(0.85)).alias("p")).crossJoin(n).select(F.when(F.col("n") < FEW, F.lit(LOW)).otherwise(F.least(F.lit(HIGH), F.greatest(F.lit(LOW), "p"))).alias("tau"))


def assign(sims: DataFrame, tau: float) -> DataFrame:
    """(id, anchor, cosine, rank): up to two anchors at cosine >= tau, the second near enough to the first."""
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "anchor")
    x = sims.withColumn("rank", F.row_number().over(w)).withColumn("best", F.max("cosine").over(Window.partitionBy("id")))
    return x.where((F.col("rank") <= 2) & (F.col("cosine") >= tau) & (F.col("cosine") >= SECOND * F.col("best"))).drop("best")


def co_memberships(sims: DataFrame, top: int = 3) -> DataFrame:
    """(id, anchor, cosine, ratio): each vector's ``top`` anchors with their share of the best cosine."""
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "anchor")
    return sims.where("cosine > 0").withColumn("rank", F.row_number().over(w)).withColumn("ratio", F.col("cosine") / F.max("cosine").over(Window.partitionBy("id"))).where(F.col("rank") <= top).select("id", "anchor", "cosine", "ratio")


def co_occurrences(activations: DataFrame) -> DataFrame:
    """(a, b, weight): anchors active in the same finding: min(1, sum of W_a W_b), W = strength^2 / sum of strengths.

    A strength of 0 links nothing: a finding whose shifts are all 0 has no share to give.
    """
    w = activations.where("strength > 0").withColumn("W", F.col("strength") * F.col("strength") / F.sum("strength").over(Window.partitionBy("id")))
    x, y = w.alias("x"), w.alias("y")
    return x.join(y, (F.col("x.id") == F.col("y.id")) & (F.col("x.anchor") < F.col("y.anchor"))).groupBy(F.col("x.anchor").alias("a"), F.col("y.anchor").alias("b")).agg(F.least(F.lit(1.0), F.sum(F.col("x.W") * F.col("y.W"))).alias("weight"))


def related(anchors: DataFrame, k: int = 3, least: float = 0.30) -> DataFrame:
    """(a, b, cosine): anchors that are among each other's ``k`` nearest, above ``least``."""
    a, b = anchors.alias("a"), anchors.alias("b")
    cos = a.join(b, F.col("a.anchor") != F.col("b.anchor")).select(F.col("a.anchor").alias("a"), F.col("b.anchor").alias("b"), (dot(F.col("a.c"), F.col("b.c")) / F.sqrt(dot(F.col("a.c"), F.col("a.c")) * dot(F.col("b.c"), F.col("b.c")))).alias("cosine")).where(F.col("cosine") > least)
    top = cos.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("r") <= k).select("a", "b", "cosine")
    back = top.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return top.join(back, ["a", "b"], "left_semi").where("a < b")


def masses(activations: DataFrame) -> DataFrame:
    return activations.groupBy("anchor").agg(F.sum("strength").alias("mass"), F.countDistinct("id").alias("members"))


def damping(activations: DataFrame) -> DataFrame:
    """(anchor, share, damping): min(1, tau / share of the mass), tau = max(0.25, 3 / anchors)."""
    m = masses(activations)
    w = Window.partitionBy(F.lit(1))
    tau = F.greatest(F.lit(0.25), 3.0 / F.count(F.lit(1)).over(w))
    return m.withColumn("share", F.col("mass") / F.sum("mass").over(w)).withColumn("damping", F.least(F.lit(1.0), tau / F.col("share"))).select("anchor", "share", "damping")


def orphans(anchors: DataFrame, activations: DataFrame) -> DataFrame:
    """Anchors without a member."""
    return anchors.select("anchor").join(activations.select("anchor").distinct(), "anchor", "left_anti")


def signature(members: DataFrame) -> DataFrame:
    """(anchor, component, value): strength-weighted sum of the members' signed components, largest first."""
    g = members.groupBy("anchor", "component").agg(F.sum(F.col("strength") * F.col("z")).alias("value"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc(F.abs("value")), "component")))


def centroids(vectors: DataFrame, activations: DataFrame) -> DataFrame:
    """(anchor, c): unit mean of the members' vectors, summed by component so that no group is gathered."""
    v = activations.join(vectors, "id").select("anchor", "strength", F.posexplode("v").alias("i", "x")).groupBy("anchor", "i").agg(F.sum(F.col("strength") * F.col("x")).alias("x"))
    return v.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p")).select("anchor", l2(F.transform("p", lambda s: s["x"])).alias("c"))


@dataclass
class AnchorState:
    """Anchors learned so far: unit centroids and masses; at most MAX_ANCHORS rows, hence on the driver."""

    centroid: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    mass: np.ndarray = field(default_factory=lambda: np.zeros(0))
    batches: set[str] = field(default_factory=set)

    def threshold(self) -> float:
        n = len(self.centroid)
        if n < FEW:
            return LOW
        s = self.centroid @ self.centroid.T
        return float(np.clip(np.quantile(s[np.triu_indices(n, 1)], 0.85), LOW, HIGH))


def _extract(x: np.ndarray, most: int) -> np.ndarray:
    """Spherical k-means with a deterministic farthest-first start and the elbow of the mean error."""
    best, last = x[:1], np.inf
    for k in range(min(4, len(x)), min(most, len(x)) + 1, 2):
        c = x[[0]]
        while len(c) < k:
            c = np.vstack([c, x[np.argmin((x @ c.T).max(1))]])
        for _ in range(25):
            at = (x @ c.T).argmax(1)
            new = np.array([x[at == j].sum(0) if (at == j).any() else c[j] for j in range(k)])
            new /= np.linalg.norm(new, axis=1, keepdims=True)
            if np.allclose(new, c):
                break
            c = new
        err = float((1 - (x @ c.T).max(1)).mean())
        if last - err < 0.015:
            break
        best, last = c, err
    keep: list[int] = []
    for j in range(len(best)):
        if all(best[j] @ best[i] < SOFT_MERGE for i in keep):
            keep.append(j)
    return best[keep]


def learn(state: AnchorState, batch: str, ids: list[str], vectors: np.ndarray, weights: np.ndarray) -> list[tuple[str, int, float]]:
    """Fold one batch of admitted findings into the anchors: assign, move, extract from orphans, merge.

    A batch has at most the admission budget of findings. The same batch again changes nothing.
    Returns (id, anchor, cosine); every finding gets at least one anchor.
    """
    if batch in state.batches or not len(ids):
        return []
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    if not len(state.centroid):
        state.centroid, state.mass = _extract(x, MAX_ANCHORS), np.zeros(0)
        state.mass = np.zeros(len(state.centroid))
    else:
        tau = state.threshold()
        lost = np.flatnonzero((x @ state.centroid.T).max(1) < tau)
        if len(lost) >= 4 and len(state.centroid) < MAX_ANCHORS:
            new = _extract(x[lost], MAX_ANCHORS - len(state.centroid))
            new = new[(new @ state.centroid.T).max(1) < SOFT_MERGE]
            state.centroid, state.mass = np.vstack([state.centroid, new]), np.concatenate([state.mass, np.zeros(len(new))])
    sims = x @ state.centroid.T
    out = []
    for i, pid in enumerate(ids):
        order = np.argsort(-sims[i], kind="stable")[:2]
        for n, j in enumerate(order):
            if n == 0 or (sims[i, j] >= state.threshold() and sims[i, j] >= SECOND * sims[i, order[0]]):
                out.append((pid, int(j), float(sims[i, j])))
                if sims[i, j] >= FLOOR:
                    a = max(0.01, 0.05 / np.sqrt(state.mass[j] + 1))
                    c = (1 - a) * state.centroid[j] + a * x[i]
                    state.centroid[j] = c / np.linalg.norm(c)
                    state.mass[j] += weights[i]
    state.batches.add(batch)
    return out


def hashed_text_vectors(df: DataFrame, key: str, text: str, dim: int = 384) -> DataFrame:
    """(key, v): words and character trigrams hashed to signed buckets, unit length; zero for no text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        import zlib

        for b in batches:
            out = np.zeros((b.num_rows, dim))
            for i, t in enumerate(b.column(1).to_pylist()):
                low = (t or "").lower()
                for g in [*low.split(), *(low[k : k + 3] for k in range(len(low) - 2))]:
                    h = zlib.crc32(g.encode())
                    out[i, h % dim] += 1 if h >> 31 else -1
            n = np.linalg.norm(out, axis=1, keepdims=True)
            yield pa.record_batch([b.column(0), pa.array(list(out / np.where(n > 0, n, 1)), pa.list_(pa.float64()))], names=[key, "v"])

    return df.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"{key} {kind}, v array<double>")


def sphere(vectors: np.ndarray, seed: int = 0) -> np.ndarray:
    """Three coordinates of a bounded set of vectors: kernel PCA on cosines, radius from the norm."""
    if not len(vectors):
        return np.zeros((0, 3))
    x = vectors / np.maximum(1e-12, np.linalg.norm(vectors, axis=1, keepdims=True))
    k = x @ x.T
    k = k - k.mean(0) - k.mean(1)[:, None] + k.mean()
    val, vec = np.linalg.eigh(k)
    y = vec[:, ::-1][:, :3] * np.sqrt(np.maximum(val[::-1][:3], 0))
    y = np.pad(y, ((0, 0), (0, 3 - y.shape[1])))
    return y / np.maximum(1e-12, np.linalg.norm(y, axis=1, keepdims=True)) * np.log1p(np.linalg.norm(vectors, axis=1, keepdims=True))
