"""Relations between findings: specialisation, siblings, contrasts, identity and near-duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONDS = "array<struct<attribute:string,value:string>>"


def scopes(insights: DataFrame) -> DataFrame:
    """(id, batch_id, dataset_id, conds, shifts, support, weight): repeated ids once, conditions as a sorted set."""
    conds = F.array_sort(F.array_distinct(F.coalesce("conditions", F.expr(f"cast(array() as {CONDS})"))))
    return insights.where("id is not null").dropDuplicates(["id"]).select("id", "batch_id", "dataset_id", conds.cast(CONDS).alias("conds"), "shifts", "support", "weight")


def _subsets(s: DataFrame) -> DataFrame:
    """(id, key): every strict subset of a finding's conditions as a key; conditions are few."""
    n = F.size("conds")
    masks = F.sequence(F.lit(0), (F.pow(F.lit(2.0), n) - 2).cast("int"))
    part = F.filter("conds", lambda c, i: F.expr("0 = 0") & (F.shiftright(F.col("mask"), 0).bitwiseAND(F.pow(F.lit(2.0), i).cast("int")) != 0))
    return s.where(n > 0).withColumn("mask", F.explode(masks)).select("id", "batch_id", n.alias("k"), F.to_json(part).alias("key"))


def specialisations(s: DataFrame) -> DataFrame:
    """(child, parent): parent's conditions are a strict subset and no finding lies strictly between.

    A child's subsets are looked up by equality, so findings of a batch never all meet each other.
    """
    parents = s.select(F.col("id").alias("parent"), "batch_id", F.size("conds").alias("kp"), F.to_json("conds").alias("key"))
    up = _subsets(s).select(F.col("id").alias("child"), "batch_id", "key").join(parents, ["batch_id", "key"]).select("child", "parent", "kp")
    between = up.alias("x").join(up.alias("y"), (F.col("x.parent") == F.col("y.child"))).select("x.child", "y.parent").distinct()
    return up.select("child", "parent").join(between, ["child", "parent"], "left_anti")


def siblings(s: DataFrame) -> DataFrame:
    """(a, b, attribute): same batch, equal but for the value of one attribute."""
    x = s.where(F.size("conds") > 0).select("id", "batch_id", "conds", F.explode("conds").alias("c"))
    rest = F.filter("conds", lambda d: d != F.col("c"))
    x = x.select("id", "batch_id", F.col("c.attribute").alias("attribute"), F.col("c.value").alias("value"), F.to_json(rest).alias("rest"))
    a, b = x.alias("a"), x.alias("b")
    on = (F.col("a.batch_id") == F.col("b.batch_id")) & (F.col("a.attribute") == F.col("b.attribute")) & (F.col("a.rest") == F.col("b.rest"))
    return a.join(b, on).where("a.id < b.id and a.value <> b.value").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "a.attribute")


def contrasts(pairs: DataFrame, s: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b, metric, strength): the strongest metric that shifts one way in a and the other in b."""
    sh = s.select("id", F.explode("shifts").alias("x")).select("id", "x.metric", F.col("x.robust_z").alias("z")).where("z is not null and not isnan(z)").groupBy("id", "metric").agg(F.max_by("z", F.abs("z")).alias("z"))
    j = pairs.join(sh.select(F.col("id").alias("a"), "metric", F.col("z").alias("za")), "a").join(sh.select(F.col("id").alias("b"), "metric", F.col("z").alias("zb")), ["b", "metric"])
    j = j.where("za * zb < 0").withColumn("strength", F.least(F.abs("za"), F.abs("zb"))).where(F.col("strength") >= least)
    return j.groupBy("a", "b").agg(F.max(F.struct("strength", "metric")).alias("m")).select("a", "b", "m.metric", "m.strength")


def condition_jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def primary_shift(shifts: Column) -> Column:
    """The shift with the largest |robust_z|; null without any."""
    ok = F.filter(shifts, lambda s: s["robust_z"].isNotNull() & ~F.isnan(s["robust_z"]))
    best = F.array_max(F.transform(ok, lambda s: F.abs(s["robust_z"])))
    return F.get(F.filter(ok, lambda s: F.abs(s["robust_z"]) == best), F.lit(0))


def phenomenon_shifts(shifts: Column, target: Column, least: float = 1.0) -> Column:
    return F.filter(shifts, lambda s: (s["metric"] == target) | (F.abs(s["robust_z"]) >= least))


def pattern_id(dataset: Column, conds: Column) -> Column:
    """P- and twelve hex digits of a digest of the dataset and its sorted expressions."""
    text = F.concat_ws("|", dataset, F.concat_ws("&", F.array_sort(F.transform(conds, lambda c: F.concat(c["attribute"], F.lit("=="), c["value"])))))
    return F.concat(F.lit("P-"), F.substring(F.sha1(text), 1, 12))


def record_digest(df: DataFrame, columns: list[str]) -> Column:
    """A digest of a record, over its fields in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def changed_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): ``added``, ``gone`` or ``changed`` rows of two versions, by a hash of the other columns."""
    cols = [c for c in new.columns if c != key]
    h = lambda d, n: d.select(key, F.xxhash64(*cols).alias(n)).dropDuplicates([key])
    j = h(old, "ho").join(h(new, "hn"), key, "full_outer")
    change = F.when(F.col("ho").isNull(), "added").when(F.col("hn").isNull(), "gone").when(F.col("ho") != F.col("hn"), "changed")
    return j.select(key, change.alias("change")).where("change is not null")


def headline(conds: Column, metric: Column, z: Column) -> Column:
    scope = F.concat_ws(" and ", F.transform(conds, lambda c: F.concat(F.regexp_replace(c["attribute"], "_", " "), F.lit(" = "), c["value"])))
    return F.concat(F.regexp_replace(metric, "_", " "), F.lit(" "), F.when(z >= 0, "↑").otherwise("↓"), F.lit(" in "), scope)


def ranked_lines(insights: DataFrame, limit: int) -> DataFrame:
    """(rank, id, line): the report of the ``limit`` heaviest findings."""
    top = insights.orderBy(F.desc("weight"), "id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("weight"), "id"))).select("rank", "id", F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("line")).alias("line"))
