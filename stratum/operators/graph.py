"""The typed property graph as node and edge tables, and bounded retrieval over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.runtime import saved

PLANES = {"SPECIALIZES": "structural", "SIBLING": "structural", "CONTRASTS": "structural", "ACTIVATES": "latent", "CO_OCCURS": "latent", "RELATED_TO": "latent", "HAS_METRIC": "schema", "HAS_DIMENSION": "schema", "IN_BATCH": "schema", "BATCH_OF": "schema", "IN_REGION": "spatial", "PARENT_OF": "spatial", "CO_LOCATED": "spatial", "PEAKED_IN": "temporal", "DROPPED_IN": "temporal", "WITHIN": "temporal"}
STRUCTURAL_FACTOR = 0.85
WALKED = ["SPECIALIZES", "CONTRASTS", "CO_LOCATED"]  # siblings are in the graph, but no walk uses them
STRUCTURAL_HOPS, LATENT_HOPS, SEED_FLOOR = 1, 1, 1e-3
MAX_DEPTH = 5


def edges(df: DataFrame, source: str, target: str, kind: str, weight: Column | float = 1.0) -> DataFrame:
    """(id, source, target, type, plane, weight) with the id TYPE:source->target."""
    w = F.lit(weight) if isinstance(weight, float) else weight
    s, t = F.col(source).cast("string"), F.col(target).cast("string")
    return df.select(F.concat(F.lit(f"{kind}:"), s, F.lit("->"), t).alias("id"), s.alias("source"), t.alias("target"), F.lit(kind).alias("type"), F.lit(PLANES[kind]).alias("plane"), w.cast("double").alias("weight"))


def schema_plane(insights: DataFrame) -> DataFrame:
    """Edges from findings to their metrics, dimensions, batches and from batches to datasets."""
    i = insights.where("id is not null").dropDuplicates(["id"])
    m = i.select("id", "dataset_id", F.explode("shifts").alias("s")).select("id", F.concat_ws(":", F.lit("M"), "dataset_id", "s.metric").alias("m")).distinct()
    d = i.select("id", "dataset_id", F.explode("conditions").alias("c")).select("id", F.concat_ws(":", F.lit("D"), "dataset_id", "c.attribute").alias("d")).distinct()
    b = i.where("batch_id is not null").select("id", F.concat(F.lit("B:"), "batch_id").alias("b"))
    o = i.where("batch_id is not null").select(F.concat(F.lit("B:"), "batch_id").alias("b"), F.concat(F.lit("DS:"), "dataset_id").alias("o")).distinct()
    return edges(m, "id", "m", "HAS_METRIC").unionByName(edges(d, "id", "d", "HAS_DIMENSION")).unionByName(edges(b, "id", "b", "IN_BATCH")).unionByName(edges(o, "b", "o", "BATCH_OF"))


def both_ways(e: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(at, to, type, weight, forward): incident edges of each node."""
    e = e.where(F.col("type").isin(types)) if types else e
    return e.select(F.col("source").alias("at"), F.col("target").alias("to"), "type", "weight", F.lit(True).alias("forward")).unionByName(e.select(F.col("target").alias("at"), F.col("source").alias("to"), "type", "weight", F.lit(False).alias("forward")))


def closure(e: DataFrame, seeds: DataFrame, depth: int = MAX_DEPTH, types: list[str] | None = None) -> DataFrame:
    """(node, distance): breadth-first, one join for each step; a node keeps its least distance."""
    step = saved(both_ways(e, types).select("at", "to").distinct(), "steps")
    seen = seeds.select(F.col("node").alias("node"), F.lit(0).alias("distance")).distinct()
    front = seen
    for d in range(1, depth + 1):
        nxt = front.select(F.col("node").alias("at")).join(step, "at").select(F.col("to").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(d))
        nxt = saved(nxt, "front")  # each step reads the one before, not all before it
        seen = seen.unionByName(nxt)
        front = nxt
    return seen


def walk(e: DataFrame, seeds: DataFrame, weights: DataFrame, structural: int = STRUCTURAL_HOPS, latent: int = LATENT_HOPS) -> DataFrame:
    """(node, score, hops, via, route): the best product of factors from a seed to each finding.

    A path has three phases: up to ``structural`` steps over WALKED edges, one step up to an anchor and
    up to ``latent`` steps between anchors, one step down to a finding that is no seed and again up to
    ``structural`` steps, none of them to a seed. Factors are at most 1, so each phase keeps the best of
    each node and number of steps. A seed's score is its own, any other finding's is multiplied by its
    weight. route: ``seed``, ``structural`` (no anchor on the path) or ``transversal``.
    """
    best = lambda df, key: df.groupBy(key).agg(F.max(F.struct("score", (-F.col("hops")).alias("h"), "via")).alias("m")).select(key, "m.score", (-F.col("m.h")).alias("hops"), "m.via")
    s = both_ways(e, WALKED).select("at", "to", F.when(F.col("type").isin("CONTRASTS", "CO_LOCATED"), STRUCTURAL_FACTOR * F.col("weight")).otherwise(F.lit(STRUCTURAL_FACTOR)).alias("f")).groupBy("at", "to").agg(F.max("f").alias("f"))
    s = saved(s, "structural")
    up = saved(e.where(F.col("type") == "ACTIVATES").groupBy(F.col("source").alias("at"), F.col("target").alias("anchor")).agg(F.max("weight").alias("f")), "latent")
    between = both_ways(e, ["RELATED_TO", "CO_OCCURS"]).groupBy(F.col("at"), F.col("to")).agg(F.max("weight").alias("f"))
    start = saved(seeds.select("node", F.greatest("score", F.lit(SEED_FLOOR)).alias("score"), F.lit(0).alias("hops"), F.col("node").alias("via")), "state")
    own = start.select("node")

    def along(state: DataFrame, steps: DataFrame, key: str, out: str) -> DataFrame:
        return state.join(steps, F.col(key) == F.col("at")).select(F.col("to").alias(out), (F.col("score") * F.col("f")).alias("score"), (F.col("hops") + 1).alias("hops"), "via")

    phase = [start]
    for _ in range(structural):
        phase.append(saved(best(along(phase[-1], s, "node", "node"), "node"), "state"))
    near = reduce(DataFrame.unionByName, phase)
    anchor = [saved(best(along(near, up.withColumnRenamed("anchor", "to"), "node", "anchor"), "anchor"), "state")]
    for _ in range(latent):
        anchor.append(saved(best(along(anchor[-1], between, "anchor", "anchor"), "anchor"), "state"))
    down = along(reduce(DataFrame.unionByName, anchor), up.select(F.col("anchor").alias("at"), F.col("at").alias("to"), "f"), "anchor", "node")
    phase = [saved(best(down.join(own, "node", "left_anti"), "node"), "state")]
    for _ in range(structural):
        phase.append(saved(best(along(phase[-1], s, "node", "node").join(own, "node", "left_anti"), "node"), "state"))
    far = reduce(DataFrame.unionByName, phase)
    total = near.withColumn("route", F.when(F.col("hops") == 0, "seed").otherwise("structural")).unionByName(far.withColumn("route", F.lit("transversal")))
    x = total.join(weights.select(F.col("id").alias("node"), "weight"), "node").withColumn("score", F.when(F.col("route") == "seed", F.col("score")).otherwise(F.col("score") * F.col("weight")))
    m = x.groupBy("node").agg(F.max(F.struct("score", (-F.col("hops")).alias("h"), "via", "route")).alias("m"))
    return m.select("node", "m.score", (-F.col("m.h")).alias("hops"), "m.via", "m.route")


def seed_scores(insights: DataFrame, target: str, attribute: str, value: str, direction: int) -> DataFrame:
    """(id, score): 0.35 target + 0.25 scope + 0.15 direction + 0.10 weight, for a lexical question."""
    i = insights.where("id is not null").dropDuplicates(["id"])
    t = F.coalesce((F.col("target") == target), F.lit(False)).cast("double")
    sc = F.coalesce(F.exists("conditions", lambda c: (c["attribute"] == attribute) & (c["value"] == value)), F.lit(False)).cast("double")
    z = F.get(F.filter("shifts", lambda s: s["metric"] == target), F.lit(0))["robust_z"]
    d = F.coalesce((F.signum(z) == direction), F.lit(False)).cast("double")
    return i.select("id", (0.35 * t + 0.25 * sc + 0.15 * d + 0.10 * F.coalesce("weight", F.lit(0.0))).alias("score"))


def seeds(scores: DataFrame, conds: DataFrame, most: int = 3, floor: float = 0.25, share: float = 0.75) -> DataFrame:
    """The best ``most`` of different scopes, at least max(floor, share x best)."""
    best = scores.agg(F.max("score").alias("best"))
    ok = scores.crossJoin(F.broadcast(best)).where(F.col("score") >= F.greatest(F.lit(floor), share * F.col("best"))).join(conds, "id")
    one = ok.withColumn("r", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("score"), "id"))).where("r = 1")
    return one.orderBy(F.desc("score"), "id").limit(most).select("id", "score")


def credibility(insights: DataFrame) -> DataFrame:
    """(id, others, level): findings of other datasets that shift the same metric the same way.

    Level 1: confirmed by another dataset with the same scope; 2: by another dataset; 6: by none.
    """
    i = insights.where("id is not null").dropDuplicates(["id"]).select("id", "dataset_id", F.to_json(F.array_sort("conditions")).alias("scope"), F.explode("shifts").alias("s")).select("id", "dataset_id", "scope", "s.metric", F.signum("s.robust_z").alias("sign")).where("sign is not null and not isnan(sign)")
    wide = i.groupBy("metric", "sign").agg(F.countDistinct("dataset_id").alias("datasets"))
    same = i.groupBy("metric", "sign", "scope").agg(F.countDistinct("dataset_id").alias("alike"))
    j = i.join(wide, ["metric", "sign"]).join(same, ["metric", "sign", "scope"])
    return j.groupBy("id").agg(F.max(F.col("datasets") - 1).alias("others"), F.min(F.when(F.col("alike") > 1, 1).when(F.col("datasets") > 1, 2).otherwise(6)).alias("level"))


def places(holds: DataFrame, most: int = 5) -> DataFrame:
    """(pattern, region, key, share): each pattern's first regions with their share of its keys."""
    w = Window.partitionBy("pattern")
    x = holds.withColumn("share", F.col("key") / F.sum("key").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("key"), "region")))
    return x.where(F.col("r") <= most).select("pattern", "region", "key", "share")


def vertical_step(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """(fine, coarse, affinity): for each finding of a fine level the nearest of the coarse one in the same region.

    ``fine``, ``coarse``: (id, region, anchor, conds). Ordered by shared anchor, then Jaccard of conditions, then id.
    """
    f, c = fine.alias("f"), coarse.alias("c")
    j = f.join(c, F.col("f.region") == F.col("c.region")).select(F.col("f.id").alias("fine"), F.col("c.id").alias("coarse"), (F.col("f.anchor") == F.col("c.anchor")).cast("int").alias("same"), (F.size(F.array_intersect("f.conds", "c.conds")) / F.greatest(F.lit(1), F.size(F.array_union("f.conds", "c.conds")))).alias("affinity"))
    return j.withColumn("r", F.row_number().over(Window.partitionBy("fine").orderBy(F.desc("same"), F.desc("affinity"), "coarse"))).where("r = 1").select("fine", "coarse", "affinity")
