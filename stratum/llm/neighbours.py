"""The most similar vectors of every vector, by a forest of random-projection trees."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.llm import vectors as V
from stratum.runtime import saved, small, spread

TREES = 4
VISITS = 6  # cells that a vector visits over all trees, its own cell in each tree among them
CELL = 2_048  # vectors in a cell that the depth of the trees aims at
MAX_DEPTH = 12  # a cell that is too large at this depth is searched by a forest of its own
SAMPLE_PER_CELL = 32
BITS = 16
SLACK = 1e-4  # more than the error of a cosine of 16-bit vectors


class Forest:
    """Hyperplanes of perfectly balanced trees, level by level: normals[level][tree, node] and offsets."""

    def __init__(self, depth: int, normals: list[np.ndarray], offsets: list[np.ndarray]):
        self.depth, self.normals, self.offsets = depth, normals, offsets

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int, trees: int, seed: int = 11) -> Forest:
        """Each node cuts between two of its sample vectors, at the median of its sample."""
        rng = np.random.default_rng(seed)
        groups = [[sample] for _ in range(trees)]
        normals, offsets = [], []
        for _ in range(depth):
            w, o, below = [], [], []
            for tree in groups:
                tw, to, tn = [], [], []
                for g in tree:
                    if len(g) > 1:
                        i, j = rng.choice(len(g), 2, replace=False)
                        d = g[i] - g[j]
                    else:
                        d = rng.normal(size=sample.shape[1])
                    size = np.linalg.norm(d)
                    d = (d / size if size > 1e-6 else _direction(rng, sample.shape[1])).astype(np.float32)
                    p = g @ d
                    mid = np.float32(np.median(p)) if len(p) else np.float32(0)
                    tw.append(d)
                    to.append(mid)
                    tn += [g[p <= mid], g[p > mid]]
                w.append(tw)
                o.append(to)
                below.append(tn)
            normals.append(np.array(w, dtype=np.float32))
            offsets.append(np.array(o, dtype=np.float32))
            groups = below
        return cls(depth, normals, offsets)

    def visits(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(own, visited): own cell in each tree, and the first ``n`` cells of the queue.

        All trees share one queue, whose priority of a node is the least signed margin on its path:
        above 0 for a node on the vector's own side throughout, below for one across a plane by that
        much. A best-first search takes cells in falling order of this priority, so the cells it
        takes are the ``n`` of highest priority; they are found a level at a time, keeping the
        ``2 n`` best nodes, which hold the best ``n`` cells since a child is never above its parent
        and each node has a child of its own priority or its margin.
        """
        trees = self.normals[0].shape[0] if self.depth else 1
        rows = np.arange(len(x))[:, None]
        tree = np.broadcast_to(np.arange(trees), (len(x), trees))
        node = np.zeros((len(x), trees), dtype=np.int64)
        prio = np.full((len(x), trees), np.inf, dtype=np.float32)
        own = np.zeros((len(x), trees), dtype=np.int64)
        for w, o in zip(self.normals, self.offsets, strict=True):
            k = w.shape[1]
            if k <= 128:
                m = (x @ w.reshape(-1, w.shape[2]).T - o.ravel())[rows, tree * k + node]
                own_m = (x @ w.reshape(-1, w.shape[2]).T - o.ravel())[rows, np.arange(trees) * k + own] if k > 1 else m[:, :trees]
            else:
                m = np.einsum("nd,ncd->nc", x, w[tree, node]) - o[tree, node]
                own_m = np.einsum("nd,ncd->nc", x, w[np.arange(trees)[None], own]) - o[np.arange(trees)[None], own]
            own = own * 2 + (own_m > 0)
            tree = np.concatenate([tree, tree], 1)
            node = np.concatenate([node * 2, node * 2 + 1], 1)
            prio = np.concatenate([np.minimum(prio, -m), np.minimum(prio, m)], 1)
            keep = max(n, trees) * 2
            if prio.shape[1] > keep:
                best = np.argpartition(-prio, keep - 1, axis=1)[:, :keep]
                tree, node, prio = tree[rows, best], node[rows, best], prio[rows, best]
        if prio.shape[1] > n:
            best = np.argpartition(-prio, n - 1, axis=1)[:, :n]
            tree, node = tree[rows, best], node[rows, best]
        return own + np.arange(trees) * 2**self.depth, tree * 2**self.depth + node


def _direction(rng: np.random.Generator, dim: int) -> np.ndarray:
    d = rng.normal(size=dim)
    return d / np.linalg.norm(d)


def _search(cell: int, names: np.ndarray, x: np.ndarray, home: np.ndarray, asks: np.ndarray, keep: int, least: float, trees: int = TREES, visits: int = VISITS):
    """(query, candidate, cosine) within one cell, the best ``keep`` of each asking row.

    A cell of more than 2 CELL homes has a forest of its own, fitted on its rows, in which each asking
    row visits ``visits`` cells, as it does among all rows.
    """
    n = int(home.sum())
    if n > 2 * CELL:
        depth = math.ceil(math.log2(n / CELL))
        homes = np.flatnonzero(home)
        rng = np.random.default_rng(int(cell) % (2**31))
        forest = Forest.fit(x[rng.permutation(homes)[: SAMPLE_PER_CELL * 2**depth]], depth, trees, seed=int(cell) % (2**31))
        n_visits = min(visits, trees * 2**depth)
        row, leaf, lives = [], [], []
        for lo in range(0, len(x), 4_096):
            own, vis = forest.visits(x[lo : lo + 4_096], n_visits)
            at = np.arange(lo, lo + len(vis))
            h, a = home[at], asks[at]
            k = a[:, None] & ~(vis[:, :, None] == own[:, None, :]).any(2)
            row += [np.repeat(at, own.shape[1]), at[np.nonzero(k)[0]]]
            leaf += [own.ravel(), vis[k]]
            lives += [np.repeat(h, own.shape[1]), np.zeros(int(k.sum()), bool)]
        row, leaf, lives = map(np.concatenate, (row, leaf, lives))
        order = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.diff(leaf[order])) + 1
        parts = [(row[k], lives[k]) for k in np.split(order, cuts)]
    else:
        parts = [(np.arange(len(x)), home)]
    for at, lives in parts:
        h, a = at[lives], at[asks[at]]
        xh = x[h]
        for lo in range(0, len(a), 1_024):
            q = a[lo : lo + 1_024]
            s = x[q] @ xh.T
            s[names[q][:, None] == names[h][None, :]] = -2.0
            if least > -1:
                r, c = np.nonzero(s >= least)
                v = s[r, c]
                order = np.lexsort((-v, r))
                r, c, v = r[order], c[order], v[order]
                first = np.searchsorted(r, np.arange(len(q)))
                ok = np.arange(len(r)) - first[r] < keep
                r, c, v = r[ok], c[ok], v[ok]
            else:
                k = min(keep, s.shape[1])
                if not k:
                    continue
                c = np.argpartition(-s, k - 1, axis=1)[:, :k]
                r, c = np.repeat(np.arange(len(q)), k), c.ravel()
                v = s[r, c]
                ok = v > -1.5
                r, c, v = r[ok], c[ok], v[ok]
            yield q[r], h[c], v


def classes(df: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """(members, first): equal directions are one class, named by its smallest id.

    members: (id, rep), ids once; first: (rep, n, firsts, q) with the ``keep`` smallest ids.
    """
    enc = saved(V.encoded(df.where("id is not null"), BITS, ["id"]).withColumn("h", F.md5("q")), "vec")
    ids = enc.select("h", "id").distinct()
    rank = Window.partitionBy("h").orderBy("id")
    top = ids.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= keep)
    first = top.groupBy("h").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("firsts"))
    first = saved(first, "classes")
    members = ids.join(first.select("h", "rep"), "h").select("id", "rep")
    q = enc.select(F.col("id").alias("rep"), "q").join(first.select("rep", "firsts"), "rep").dropDuplicates(["rep"])
    return members, q


def similar(df: DataFrame, k: int, least: float = -2.0, asked: str | None = None, trees: int = TREES, visits: int = VISITS) -> DataFrame:
    """(id, other, rank, cosine): the ``k`` most similar other ids of each id, cosine at least ``least``.

    ``df``: (id, enc). Vectors that aren't 120 finite numbers, or are all zero, take no part; ids
    repeated count once; ties go to the smaller id. ``asked``: an SQL predicate on id for the rows that
    ask (default all); all rows answer.

    The trees are fitted on a sample of 32 vectors a cell (chosen by a hash of the id; about
    131,072 at most) and hold every row: a row lives in one cell of each tree and visits the ``visits`` first
    cells of its queue over all trees. Vectors travel with 16 bits a component; within a cell they
    are compared exactly as such. Where the last place in a list or the limit is closer than the
    rounding, the full vectors decide. Rows of equal direction are searched as one and each gets
    the smallest ids of the others, so that copies cost nothing.
    """
    members, q = classes(df, k + 1)
    q = saved(q, "reps")
    members = saved(members, "members")
    n = q.count()
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, n) / CELL))))
    spark = df.sparkSession
    if n == 0:
        return members.select("id", F.col("id").alias("other"), F.lit(1).alias("rank"), F.lit(1.0).alias("cosine")).limit(0)
    share = min(1.0, SAMPLE_PER_CELL * 2**depth / n)  # of the rows, by a hash of the id: about 131,072 at most, read by no sort and no merge
    drawn = F.pmod(F.xxhash64("rep", F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = sorted(q.where(drawn).select("q").toPandas()["q"]) if depth else []
    forest = Forest.fit(V.floats(pa.array(list(sample), pa.binary()), BITS, V.DIM), depth, trees) if depth else Forest(0, [], [])
    shared = spark.sparkContext.broadcast((forest.normals, forest.offsets))  # at most 2^12 planes a tree
    n_visits = min(visits, trees * 2**depth) if depth else 1
    n_trees = trees if depth else 1

    def route(batches):
        planes = Forest(depth, *shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 4_096):
                part = b.slice(at, 4_096)
                own, vis = planes.visits(V.floats(part.column(1), BITS, V.DIM), n_visits)
                is_home = (vis[:, :, None] == own[:, None, :]).any(2)
                missing = ~(own[:, :, None] == vis[:, None, :]).any(2)  # own cells are kept as homes even if not visited
                row = np.concatenate([np.repeat(np.arange(len(vis)), n_visits), np.nonzero(missing)[0]])
                cell = np.concatenate([vis.ravel(), own[missing]])
                home = np.concatenate([is_home.ravel(), np.ones(int(missing.sum()), bool)])
                take = pa.array(row)
                ask = part.column(2).take(take) if asked else pa.array(np.ones(len(row), bool))
                keep = pa.array(home | np.array(ask.to_numpy(zero_copy_only=False), dtype=bool))
                yield pa.record_batch([pa.array(cell), part.column(0).take(take), part.column(1).take(take), pa.array(home), ask], names=["cell", "rep", "q", "home", "ask"]).filter(keep)

    rep_kind = q.schema["rep"].dataType.simpleString()
    if asked is not None:
        asking = members.where(asked).select("rep").distinct().withColumn("ask", F.lit(True))
        q_routed = q.join(asking, "rep", "left").select("rep", "q", F.coalesce("ask", F.lit(False)).alias("ask"))
    else:
        q_routed = q.select("rep", "q", F.lit(True).alias("ask"))
    copies = q_routed.mapInArrow(route, f"cell bigint, rep {rep_kind}, q binary, home boolean, ask boolean")
    parts = spread(spark, n * (n_visits + 1) * 290.0)
    keep_n = k + 3

    def compare(batches):
        t = V.whole_partition(batches)
        if t is None:
            return
        t = t.sort_by("cell")
        cells = t["cell"].to_numpy()
        names_all = t["rep"].combine_chunks()
        names_all = names_all.combine_chunks() if isinstance(names_all, pa.ChunkedArray) else names_all
        code = names_all.dictionary_encode().indices.to_numpy()
        home, ask = (t[c].combine_chunks().to_numpy(zero_copy_only=False).astype(bool) for c in ("home", "ask"))
        cuts = np.flatnonzero(np.diff(cells)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(cells)], strict=True):
            x = V.floats(t["q"].slice(lo, hi - lo), BITS, V.DIM)
            for a, b, s in _search(cells[lo], code[lo:hi], x, home[lo:hi], ask[lo:hi], keep_n, least - SLACK, trees, visits):
                yield pa.record_batch([names_all.take(pa.array(a + lo)), names_all.take(pa.array(b + lo)), pa.array(s.astype(np.float64))], names=["a", "b", "s"])

    pairs = copies.repartition(parts, "cell").mapInArrow(compare, f"a {rep_kind}, b {rep_kind}, s double")
    best = pairs.repartition("a").groupBy("a", "b").agg(F.max("s").alias("s")).withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))).where(F.col("rank") <= keep_n)
    best = saved(best, "pairs")
    exact = _settle(best, df, k, least)
    return _members(exact, q.select("rep", "firsts"), members, k, least, asked)


def _settle(best: DataFrame, df: DataFrame, k: int, least: float) -> DataFrame:
    """(a, b, s): candidates with exact cosines where the rounding could matter, at least ``least``."""
    w = Window.partitionBy("a").orderBy("rank")
    near = F.abs(F.col("s") - least) < SLACK
    tie = (F.col("rank") > k - 1) & (F.col("rank") <= k + 3) & (F.abs(F.col("s") - F.lag("s").over(w)) < SLACK)
    flagged = best.withColumn("odd", near | F.coalesce(tie, F.lit(False))).groupBy("a").agg(F.max("odd").alias("odd")).where("odd").select("a")
    flagged = saved(flagged, "odd")
    if flagged.isEmpty():
        return best.where(F.col("s") >= least).select("a", "b", "s")
    few = small(flagged, 50_000)
    odd = best.join(few, "a", "left_semi").select("a", "b")
    ends = saved(odd.select(F.col("a").alias("id")).union(odd.select("b")).distinct(), "ends")
    full = V.usable(df).join(small(ends, 100_000), "id", "left_semi").select("id", "enc").dropDuplicates(["id"])
    full = saved(full, "full")
    redone = odd.join(full.select(F.col("id").alias("a"), F.col("enc").alias("ea")), "a").join(full.select(F.col("id").alias("b"), F.col("enc").alias("eb")), "b").select("a", "b", V.cosine("ea", "eb").alias("s"))
    return best.join(few, "a", "left_anti").select("a", "b", "s").unionByName(redone).where(F.col("s") >= least)


def _members(exact: DataFrame, firsts: DataFrame, members: DataFrame, k: int, least: float, asked: str | None) -> DataFrame:
    """From classes to ids: others of the own class first, then the classes in order of cosine."""
    ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))).where(F.col("rank") <= k)
    lists = ranked.join(firsts.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "b", "firsts"))).alias("near"))
    near = F.flatten(F.transform("near", lambda c: F.transform(c["firsts"], lambda i: F.struct(i.alias("other"), (-c["s"]).alias("cosine")))))
    who = members.where(asked) if asked else members
    own = firsts.withColumnRenamed("firsts", "same")
    j = who.join(own, "rep").join(lists.withColumnRenamed("a", "rep"), "rep", "left")
    same = F.transform(F.filter("same", lambda i: i != F.col("id")), lambda i: F.struct(i.alias("other"), F.lit(1.0).alias("cosine")))
    out = j.select("id", F.posexplode(F.slice(F.concat(same, F.coalesce(near, F.expr("cast(array() as array<struct<other:string,cosine:double>>)"))), 1, k)).alias("rank", "x"))
    return out.select("id", "x.other", (F.col("rank") + 1).alias("rank"), "x.cosine").where(F.col("cosine") >= least)


def found_pairs(df: DataFrame, k: int = 5, least: float = 0.90) -> DataFrame:
    """(insight_a, insight_b), a < b: one is among the other's ``k`` most similar, cosine at least ``least``."""
    s = similar(df, k, least)
    return s.select(F.least("id", "other").alias("insight_a"), F.greatest("id", "other").alias("insight_b")).distinct()
