"""Groups of mutually similar records: MinHash banding, exact comparison of what it left apart, connected components."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.llm import vectors as V
from stratum.operators.components import connected_components, roots
from stratum.runtime import forget, process_cache, saved, small, spread

BITS = 8  # a component, of vectors that travel to their buckets
FINE = 16  # a component, of vectors that are compared with all others
BLOCK = 2_048  # rows of one metric and sign that are compared with as many others at once
TOP = 40  # a vector's set: its 40 largest components, each with its sign
BANDS = 10
BRANCHES, LEVELS = 6, 3  # a crowded bucket goes on to BRANCHES buckets of one MinHash row more, LEVELS times
CROWDED = 8_192  # rows of a bucket above which it is split, or compared in blocks
VOCAB = 2 * V.DIM
LINK = "a string, b string, degree int"


def token_sets(u: np.ndarray, top: int = TOP) -> np.ndarray:
    """The signed positions of the largest components: [row, top] tokens below VOCAB."""
    at = np.argpartition(-np.abs(u), top - 1, axis=1)[:, :top]
    return at * 2 + (np.take_along_axis(u, at, 1) > 0)


def minhash(tokens: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """[row]: the token that comes first in the k-th fixed permutation of the vocabulary."""
    held = process_cache().setdefault("minhash", {})
    if k not in held:
        held[k] = np.random.default_rng([seed, k]).permutation(VOCAB).astype(np.uint8)
    return held[k][tokens].min(1)


def errors(x: np.ndarray, bits: int) -> np.ndarray:
    """How far each vector of ``bits`` bits can be from its origin, in radians: two of these bound the error of a cosine.

    A component is off by half a step (by a little more at BITS, which are cut from FINE); the largest
    component has 2 ** (bits - 1) - 1 steps. 1e-5 is for sums of 32 bits.
    """
    return (0.51 * np.sqrt(x.shape[1]) / (2 ** (bits - 1) - 1) * np.abs(x).max(1) + 1e-5).astype(np.float32)


def mix(h: np.ndarray, x) -> np.ndarray:
    """A 64-bit hash of a hash and a number."""
    z = (h.astype(np.uint64) ^ (np.asarray(x, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(29))


def banded(key: np.ndarray, tokens: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(path, bucket) of each row in each band."""
    with np.errstate(over="ignore"):
        return [(np.full(len(key), band), mix(mix(key, band), minhash(tokens, band))) for band in range(BANDS)]


def branched(bucket: np.ndarray, path: np.ndarray, tokens: np.ndarray, level: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(path, bucket) of each row in each branch of its bucket; no two paths share a MinHash row."""
    out = []
    for e in range(BRANCHES):
        p, h = path * BRANCHES + e, np.empty(len(path), dtype=np.uint64)
        for x in np.unique(p):
            at = p == x
            with np.errstate(over="ignore"):
                h[at] = mix(mix(bucket[at], 1_000 + e), minhash(tokens[at], level * 100_000 + int(x)))
        out.append((p, h))
    return out


def prepared(insights: DataFrame) -> DataFrame:
    """(id, k, h, q): usable vectors with a primary shift; k names its metric and sign, h the class.

    The primary shift is the first of those with the largest |robust_z|; a shift of 0 counts as
    positive. Null metrics and null or NaN robust_z are no shifts.
    """
    ok = "filter(shifts, s -> s is not null and s.metric is not null and s.robust_z is not null and not isnan(s.robust_z))"
    p = insights.where("id is not null").withColumn("ok", F.expr(ok)).withColumn("most", F.expr("array_max(transform(ok, s -> abs(s.robust_z)))"))
    p = p.withColumn("top", F.expr("get(filter(ok, s -> abs(s.robust_z) = most), 0)")).where("top is not null")
    p = p.select("id", F.xxhash64("top.metric", F.col("top.robust_z") >= 0).alias("k"), "enc")
    return V.encoded(p, FINE, ["id", "k"]).withColumn("h", F.md5(F.concat(F.col("q"), F.encode(F.col("k").cast("string"), "utf-8"))))


def links(insights: DataFrame, least: float = 0.65, crowded: int = CROWDED) -> DataFrame:
    """(a, b, degree_a): links that span each group of rows connected by cosines of at least ``least``.

    A vector is represented by the set of its largest signed components; BANDS MinHash values of the
    set, each with the primary shift's metric and sign, name its buckets. All pairs within a bucket
    are compared with vectors of 8 bits a component; each bucket returns only a star for each of its
    groups connected by pairs that are surely linked, so that no group is expanded into pairs. Buckets
    of more than ``crowded`` rows are split by further MinHash rows, LEVELS times; what is crowded
    even then is compared whole (:func:`_blocks`). Links that no bucket holds, or that are closer to
    the limit than the rounding, come from :func:`_apart`, so that none is missed. Equal vectors are
    one class with a star of its ids. degree: links of the row within its fullest bucket.
    """
    spark = insights.sparkSession
    vec = saved(prepared(insights), "vec")
    ids = vec.groupBy("h", "id").agg(F.first("k").alias("k"))
    reps = saved(ids.groupBy("h", "k").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "reps")
    copies = ids.join(reps.where("n > 1").select("h", "rep"), "h").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0).alias("degree"))
    copies = saved(copies, "copies")
    one = saved(vec.join(reps.select(F.col("rep").alias("id"), F.col("n")), "id").dropDuplicates(["id"]).select("id", "k", "q"), "one")
    forget(vec)
    n_rows = one.count()

    first, hot, calm, level = one.select("id", "k", "q"), None, [], 0
    while True:
        source = first if hot is None else hot
        routed = source.mapInArrow(_route(level), "bucket bigint, path int, id string, q binary")
        many = saved(_crowded(source, level, crowded), "crowded") if n_rows > crowded else None
        if many is None or many.isEmpty():
            calm.append(routed)
            hot = None
            break
        known = small(many.select("bucket"), 500_000)
        calm.append(routed.join(known, "bucket", "left_anti"))
        hot = saved(routed.join(known, "bucket", "left_semi"), "hot")
        if level == LEVELS:
            break
        level += 1
    blocks = _blocks(hot, many, least, crowded) if hot is not None else None

    def compare(batches):
        t = V.whole_partition(batches)
        if t is None:
            return
        t = t.sort_by("bucket")
        b = t["bucket"].to_numpy()
        ids = t["id"].combine_chunks()
        cuts = np.flatnonzero(np.diff(b)) + 1
        sure, deg = [], []
        for lo, hi in zip([0, *cuts], [*cuts, len(b)], strict=True):
            if hi - lo < 2:
                continue
            _bucket(V.floats(t["q"].slice(lo, hi - lo), BITS, V.DIM), np.arange(lo, hi), least, sure, deg)
        if sure:
            s = np.concatenate(sure)
            yield pa.record_batch([ids.take(pa.array(s[:, 0])), ids.take(pa.array(s[:, 1])), pa.array(np.concatenate(deg), pa.int32())], names=["a", "b", "degree"])

    parts = spread(spark, n_rows * BANDS * 170.0)
    found = reduce(DataFrame.unionByName, calm).select("bucket", "id", "q").repartition(parts, "bucket").mapInArrow(compare, LINK)
    if blocks is not None:
        found = found.unionByName(blocks)
    found = saved(found.unionByName(copies).groupBy("a", "b").agg(F.max("degree").alias("degree")), "links")
    return found.unionByName(_apart(insights, one, found, copies, n_rows, least))


def _apart(insights: DataFrame, one: DataFrame, found: DataFrame, copies: DataFrame, n_rows: int, least: float) -> DataFrame:
    """(a, b, degree): links that join the groups of ``found``: none is missed.

    Blocks of up to BLOCK rows of one metric and sign meet each other once, in a Cartesian product
    that each task reads from the saved blocks, so nothing is shuffled; blocks that lie in one and the
    same group are passed over. A pair of blocks returns a star for each set of groups that it joins.
    Pairs closer to the limit than the rounding of 16-bit vectors are compared in full, with all
    vectors of both classes. The work is the square of the rows of a metric and sign.
    """
    spark = insights.sparkSession
    group = saved(connected_components(found), "groups")
    rows = one.join(group, "id", "left").select("id", "k", F.xxhash64(F.coalesce("root", "id")).alias("root"), "q")
    rows = rows.repartitionByRange(spread(spark, n_rows * 300.0), "k", "root", "id")
    blocks = saved(rows.mapInArrow(_packed, "block bigint, k bigint, only bigint, ids array<string>, roots binary, q binary"), "blocks")
    forget(one)
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(n_rows * 300.0 / 64e6) + 1)  # their square is the number of tasks
    x, y = (blocks.coalesce(tasks).select([F.col(c).alias(f"{c}_{side}") for c in blocks.columns]) for side in "xy")
    once = (F.col("block_x") == F.col("block_y")) | (((F.col("block_x") + F.col("block_y")) % 2 == 0) == (F.col("block_x") < F.col("block_y")))
    mixed = F.col("only_x").isNull() | F.col("only_y").isNull() | (F.col("only_x") != F.col("only_y"))

    def compare(batches):
        for b in batches:
            for n in range(b.num_rows):
                p, q = (V.floats(b.column(c).slice(n, 1), FINE, V.DIM) for c in ("q_x", "q_y"))
                root = np.concatenate([np.frombuffer(b.column(c)[n].as_py(), np.int64) for c in ("roots_x", "roots_y")])
                at, other, sure = _joins(p, q, root, least)
                if len(at):
                    ids = pa.concat_arrays([b.column(c)[n].values for c in ("ids_x", "ids_y")])
                    yield pa.record_batch([ids.take(pa.array(at)), ids.take(pa.array(other)), pa.array(sure)], names=["a", "b", "sure"])

    met = x.hint("shuffle_replicate_nl").join(y, (F.col("k_x") == F.col("k_y")) & once & mixed)
    more = saved(met.select("ids_x", "roots_x", "q_x", "ids_y", "roots_y", "q_y").mapInArrow(compare, "a string, b string, sure boolean").distinct(), "joins")
    forget(blocks)
    sure, unsure = more.where("sure").select("a", "b"), more.where("not sure").select("a", "b")
    if not unsure.isEmpty():
        ends = saved(unsure.select(F.col("a").alias("rep")).union(unsure.select("b")).distinct(), "ends")
        ids = ends.select("rep", F.col("rep").alias("id")).unionByName(copies.select(F.col("a").alias("rep"), F.col("b").alias("id")).join(small(ends, 100_000), "rep", "left_semi"))
        full = saved(V.usable(insights).join(small(saved(ids, "members"), 100_000), "id").select("rep", "enc").distinct(), "full")
        true = unsure.join(full.select(F.col("rep").alias("a"), F.col("enc").alias("ea")), "a").join(full.select(F.col("rep").alias("b"), F.col("enc").alias("eb")), "b").where(V.cosine("ea", "eb") >= least)
        sure = sure.unionByName(true.select("a", "b").distinct())
    return sure.withColumn("degree", F.lit(1))


def _packed(batches):
    """Rows (id, k, root, q) of a partition in blocks of up to BLOCK rows of one k, in the order of their roots; only: the root of all, if one."""
    t = V.whole_partition(batches)
    if t is None:
        return
    t = t.sort_by([("k", "ascending"), ("root", "ascending")]).combine_chunks()
    k, root = t["k"].to_numpy(), t["root"].to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(k)) + 1), len(k)]
    ranges = [(lo, min(lo + BLOCK, end)) for start, end in zip(cuts, cuts[1:], strict=False) for lo in range(start, end, BLOCK)]
    first = TaskContext.get().partitionId() << 32
    for n, (lo, hi) in enumerate(ranges):
        part = t.slice(lo, hi - lo)
        only = int(root[lo]) if root[lo] == root[hi - 1] else None
        held = [first + n, int(k[lo]), only, part["id"].to_pylist(), root[lo:hi].tobytes(), b"".join(part["q"].to_pylist())]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary()]
        yield pa.record_batch([pa.array([v], kind) for v, kind in zip(held, kinds, strict=True)], names=["block", "k", "only", "ids", "roots", "q"])


def _joins(x: np.ndarray, y: np.ndarray, root: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, sure): stars of the groups that links between x and y join, and unsure pairs of groups still apart; rows of y follow those of x."""
    ex, ey = errors(x, FINE), errors(y, FINE)
    s = x @ y.T
    r, c = np.divmod(np.flatnonzero(s >= np.float32(least - ex.max() - ey.max())), len(y))
    apart = root[r] != root[len(x) + c]
    r, c = r[apart], c[apart]
    if not len(r):
        return r, c, np.zeros(0, bool)
    over, e = s[r, c] - least, ex[r] + ey[c]
    c += len(x)
    names, first, code = np.unique(root, return_index=True, return_inverse=True)
    sure = over >= e
    label = roots(code[r[sure]], code[c[sure]], len(names))
    star = np.flatnonzero(label != np.arange(len(names)))
    odd = ~sure & (over >= -e) & (label[code[r]] != label[code[c]])
    return np.concatenate([first[label[star]], r[odd]]), np.concatenate([first[star], c[odd]]), np.arange(len(star) + int(odd.sum())) < len(star)


def _names(b: pa.RecordBatch, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(path, bucket) of all copies of a batch's rows, copy by copy."""
    tokens = token_sets(V.floats(b.column("q"), BITS if level else FINE, V.DIM))
    if not level:
        got = banded(b.column("k").to_numpy().astype(np.uint64), tokens)
    else:
        got = branched(b.column("bucket").to_numpy().view(np.uint64), b.column("path").to_numpy(), tokens, level)
    return np.concatenate([p for p, _ in got]), np.concatenate([h for _, h in got])


def _route(level: int):
    """Rows to their buckets: (id, k, q) at level 0, where q gets BITS, else (bucket, path, id, q) of crowded buckets to their branches."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 8_192):
                part = b.slice(at, 8_192)
                path, bucket = _names(part, level)
                q = part.column("q") if level else V.blobs(V.fixed_point(V.floats(part.column("q"), FINE, V.DIM), BITS)[0])
                take = pa.array(np.tile(np.arange(part.num_rows), len(bucket) // part.num_rows))
                yield pa.record_batch([pa.array(bucket.view(np.int64)), pa.array(path.astype(np.int32)), part.column("id").take(take), q.take(take)], names=["bucket", "path", "id", "q"])

    return run


def _crowded(source: DataFrame, level: int, crowded: int) -> DataFrame:
    """(bucket, n) of the buckets of more than ``crowded`` rows."""

    def count(batches):
        for b in batches:
            if b.num_rows:
                names, n = np.unique(_names(b, level)[1], return_counts=True)
                yield pa.record_batch([pa.array(names.view(np.int64)), pa.array(n.astype(np.int64))], names=["bucket", "n"])

    return source.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > crowded)


def _blocks(hot: DataFrame, many: DataFrame, least: float, crowded: int) -> DataFrame:
    """Links that span the surely connected groups of crowded buckets.

    Each bucket's first row links all rows surely near to it, which are thereby one group. The
    others are compared with every row of the bucket, in blocks of about ``crowded`` by ``crowded``
    rows dealt over tasks, each of which returns stars of its connected groups. In a bucket of nearly
    equal vectors hardly any row is left after the first step; the work is quadratic only in rows
    that share 1 + LEVELS MinHash rows and yet aren't near the first.
    """
    spark = hot.sparkSession
    lead = saved(hot.groupBy("bucket").agg(F.min(F.struct("id", "q")).alias("l")).select("bucket", F.col("l.id").alias("lid"), F.col("l.q").alias("lq")), "lead")

    def near(batches):
        for b in batches:
            if b.num_rows:
                x, y = V.floats(b.column("q"), BITS, V.DIM), V.floats(b.column("lq"), BITS, V.DIM)
                yield pa.record_batch([b.column("bucket"), b.column("id"), b.column("q"), b.column("lid"), pa.array((x * y).sum(1) >= least + errors(x, BITS) + errors(y, BITS))], names=["bucket", "id", "q", "lid", "linked"])

    x = saved(hot.join(small(lead, 50_000), "bucket").select("bucket", "id", "q", "lid", "lq").mapInArrow(near, "bucket bigint, id string, q binary, lid string, linked boolean"), "near")
    linked = x.where("linked and id <> lid")
    stars = linked.select(F.col("lid").alias("a"), F.col("id").alias("b"), F.lit(1).alias("degree"))
    heads = linked.groupBy("bucket", "lid").agg(F.count(F.lit(1)).cast("int").alias("degree")).select(F.col("lid").alias("a"), F.col("lid").alias("b"), "degree")
    rest = x.where("not linked")
    parts_of = lambda n: F.ceil(F.col(n) / crowded).cast("int")
    size = rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).join(many, "bucket").select("bucket", "n", "m", parts_of("n").alias("all_in"), parts_of("m").alias("rest_in"))
    size = saved(size, "sizes")
    if size.isEmpty():
        return stars.unionByName(heads)
    known = small(size, 100_000)
    part = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = rest.join(known, "bucket").select("bucket", "id", "q", F.lit(True).alias("ask"), part("rest_in", 1).alias("r"), every("all_in").alias("s"))
    alls = x.join(known, "bucket").select("bucket", "id", "q", F.lit(False).alias("ask"), every("rest_in").alias("r"), part("all_in", 2).alias("s"))
    copies = size.agg(F.sum(F.col("m") * F.col("all_in") + F.col("n") * F.col("rest_in"))).first()[0]

    def compare(batches):
        t = V.whole_partition(batches)
        if t is None:
            return
        t = t.sort_by([(c, "ascending") for c in ("bucket", "r", "s", "ask")])
        key = np.stack([t[c].to_numpy() for c in ("bucket", "r", "s")])
        ask = t["ask"].to_numpy().astype(bool)
        cuts = np.flatnonzero((np.diff(key) != 0).any(0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, t.num_rows], strict=True):
            mid = int((~ask[lo:hi]).sum())
            if mid in (0, hi - lo):
                continue
            code = t["id"].slice(lo, hi - lo).combine_chunks().dictionary_encode()
            v = V.floats(t["q"].slice(lo, hi - lo), BITS, V.DIM)
            at = code.indices.to_numpy()
            yield _forest(code.dictionary, at[mid:], v[mid:], at[:mid], v[:mid], least)

    pairs = asks.unionByName(alls).repartition(spread(spark, copies * 170.0), "bucket", "r", "s").mapInArrow(compare, LINK)
    return stars.unionByName(heads).unionByName(pairs)


def _forest(names: pa.Array, ask: np.ndarray, x: np.ndarray, other: np.ndarray, y: np.ndarray, least: float) -> pa.RecordBatch:
    """Stars of the groups that sure links between two blocks of rows connect."""
    a, b, ex, ey = [], [], errors(x, BITS), errors(y, BITS)
    degree = np.zeros(len(names), dtype=np.int64)
    for lo in range(0, len(x), 2_048):
        s = x[lo : lo + 2_048] @ y.T
        s[ask[lo : lo + 2_048, None] == other[None, :]] = -1
        degree[ask[lo : lo + 2_048]] = (s >= least).sum(1)
        r, c = np.nonzero(s - ey >= least + ex[lo : lo + 2_048, None])
        a.append(ask[lo + r])
        b.append(other[c])
    a, b = map(np.concatenate, (a, b))
    root = roots(np.minimum(a, b), np.maximum(a, b), len(names))
    star = np.flatnonzero(root != np.arange(len(names)))
    return pa.record_batch([names.take(pa.array(root[star])), names.take(pa.array(star)), pa.array(degree[star], pa.int32())], names=["a", "b", "degree"])


def _bucket(x: np.ndarray, at: np.ndarray, least: float, sure: list, deg: list) -> None:
    """Stars of the surely connected groups of one bucket, with the links of each row."""
    n = len(x)
    a, b, e = [], [], errors(x, BITS)
    degree = np.zeros(n, dtype=np.int64)
    for lo in range(0, n, 2_048):
        s = x[lo : lo + 2_048] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -1
        hit = s - e >= least + e[lo : lo + 2_048, None]
        degree[lo : lo + len(s)] = (s >= least).sum(1)
        r, c = np.nonzero(hit)
        k = c > r + lo
        a.append(r[k] + lo)
        b.append(c[k])
    root = roots(np.concatenate(a), np.concatenate(b), n)
    star = np.flatnonzero(root != np.arange(n))
    if len(star):
        sure.append(np.stack([at[root[star]], at[star]], 1))
        deg.append(degree[star])
        heads = np.unique(root[star])
        sure.append(np.stack([at[heads], at[heads]], 1))  # a head's own degree travels as a self-link
        deg.append(degree[heads])


def found_clusters(insights: DataFrame, least: float = 0.65, min_size: int = 5) -> DataFrame:
    """(insight_id, cluster_id): members of connected sets of at least ``min_size`` ids.

    Rows without a usable vector or a shift belong to no cluster; repeated ids count once.
    """
    comp = saved(connected_components(links(insights, least)), "components")
    big = comp.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
    return comp.join(big, "root").select(F.col("id").alias("insight_id"), F.col("root").alias("cluster_id"))


MEDOIDS = 16  # medoids that an open set may get in one round


def described_clusters(insights: DataFrame, least: float = 0.65, min_size: int = 5, loose: float = 0.75, typical: int = 3) -> DataFrame:
    """(cluster_id, size, density, typical): groups with their most typical members.

    A connected set whose members' mean cosine to its highest-degree medoid is below ``loose`` is
    split: members within ``least`` of a medoid form a group with it and the rest looks for its next
    medoids, until nobody is left. Each round has up to four times as many medoids as the last, at
    most MEDOIDS for each set; they are taken by degree, and one that is near an earlier one is none.
    Typical are the ``typical`` members nearest to the medoid; density is the mean cosine to it.
    """
    link = saved(links(insights, least), "links")
    comp = saved(connected_components(link), "components")
    big = comp.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size).select("root")
    degree = link.select(F.col("b").alias("id"), "degree").groupBy("id").agg(F.max("degree").alias("degree"))
    vec = V.usable(insights.where("id is not null")).select("id", "enc").dropDuplicates(["id"])
    open_ = saved(comp.join(big, "root").join(degree, "id", "left").join(vec, "id").select("root", "id", F.coalesce("degree", F.lit(0)).alias("degree"), "enc"), "open")
    done: list[DataFrame] = []
    while True:
        m = min(MEDOIDS, 4 ** len(done))
        by = Window.partitionBy("root").orderBy(F.desc("degree"), "id")
        top = saved(open_.withColumn("r", F.row_number().over(by)).where(F.col("r") <= m).select("root", "r", F.col("id").alias("medoid"), F.col("enc").alias("em")), "medoids")
        if m > 1:  # a medoid within `least` of one before it is none
            before = top.select("root", F.col("r").alias("s"), F.col("em").alias("ey"))
            late = top.join(before, "root").where((F.col("s") < F.col("r")) & (V.cosine("em", "ey") >= least)).select("medoid").distinct()
            top = saved(top.join(late, "medoid", "left_anti"), "medoids")
        held = top.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("r", "medoid", "em"))).alias("held"))
        each = F.transform("held", lambda h: F.struct(h["medoid"].alias("medoid"), V.cosine(F.col("enc"), h["em"]).alias("c")))
        near = open_.join(small(held, 5_000), "root").select("root", "id", "degree", "enc", each.alias("each"))
        near = near.withColumn("fit", F.get(F.filter("each", lambda e: e["c"] >= least), F.lit(0)))
        if not done:
            tight = near.groupBy("root").agg(F.avg(F.get("each", F.lit(0))["c"]).alias("mean")).where(F.col("mean") >= loose).select("root", F.lit(True).alias("tight"))
            near = near.join(tight, "root", "left").withColumn("fit", F.when(F.col("tight"), F.get("each", F.lit(0))).otherwise(F.col("fit")))
        near = saved(near.select("root", "id", "degree", "enc", F.col("fit.medoid").alias("medoid"), F.col("fit.c").alias("c")), "near")
        done.append(near.where("medoid is not null").select("medoid", "id", "c"))
        open_ = near.where("medoid is null").select("root", "id", "degree", "enc")
        if open_.isEmpty():
            break
    parts = reduce(DataFrame.unionByName, done)
    rank = Window.partitionBy("medoid").orderBy(F.desc("c"), "id")
    best = parts.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= typical).groupBy("medoid").agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("t")).select("medoid", F.expr("array_join(transform(t, x -> x.id), ' ')").alias("typical"))
    size = parts.groupBy("medoid").agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("c"), 6).alias("density"), F.min("id").alias("cluster_id"))
    return size.join(best, "medoid").select("cluster_id", "size", "density", "typical")
