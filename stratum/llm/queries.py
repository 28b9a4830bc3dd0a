"""Driver-facing queries of the operators for training data, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import clusters, leaks, neighbours, quantiles, residue, tokens
from stratum.runtime import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.wrong_statements(load(spark, d, "deliveries"), load(spark, d, "dataset_profiles"), load(spark, d, "insights"))


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "deliveries")
    long = t.select("dataset_id", F.explode(F.create_map(*[x for m in quantiles.METRICS for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "value"))
    return quantiles.percentiles(long, ["dataset_id", "metric"], [0.05, 0.25, 0.5, 0.75, 0.95])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.found_pairs(load(spark, d, "insights").select("id", "enc"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.found_clusters(load(spark, d, "insights").select("id", "enc", "shifts"))


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.described_clusters(load(spark, d, "insights").select("id", "enc", "shifts"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(load(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(load(spark, d, "documents")).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_percentiles, p2_found, p6_found, p6_clusters, p7_ids, p8_found, p9_found)}

_VALID = "(SELECT DISTINCT ON (id) id, enc::DOUBLE[] AS v, shifts FROM insights WHERE id IS NOT NULL AND enc IS NOT NULL AND len(enc) = 120 AND len(list_filter(enc, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(enc, lambda x: x <> 0)) > 0)"
_UNIT = f"u AS (SELECT id, shifts, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM {_VALID})"
_VALUE = " ".join(f"WHEN '{m}' THEN {m}::DOUBLE" for m in quantiles.METRICS)
_DIM = " ".join(f"WHEN '{c}' THEN {c}" for c in quantiles.DIMS)
_WRONG = "HAVING count(*) FILTER (x <= v) < 0.45 * count(*) OR count(*) FILTER (x < v) > 0.55 * count(*)"

SQL: dict[str, str] = {
    "p1_found": f"""WITH said AS (
  SELECT profile_id AS record_id, dataset_id, batch_id, [] AS conds, e.key AS metric, 'global_median' AS field, e.value AS v FROM (SELECT *, unnest(map_entries(global_medians)) AS e FROM dataset_profiles)
  UNION ALL SELECT profile_id, dataset_id, batch_id, [], e.key, 'global_mad', e.value FROM (SELECT *, unnest(map_entries(global_mads)) AS e FROM dataset_profiles)
  UNION ALL SELECT id, dataset_id, batch_id, conds, s.metric, f, CASE f WHEN 'local_median' THEN s.local_median WHEN 'global_median' THEN s.global_median ELSE s.global_mad END
    FROM (SELECT DISTINCT id, dataset_id, batch_id, list_transform(coalesce(conditions, []), lambda c: c.attribute || '=' || c.value) AS conds, unnest(shifts) AS s FROM insights), (SELECT unnest(['local_median', 'global_median', 'global_mad']) AS f)),
asked AS (SELECT DISTINCT * FROM said WHERE v IS NOT NULL AND NOT isnan(v)),
hit AS (SELECT a.*, CASE a.metric {_VALUE} END AS x FROM asked a JOIN deliveries t ON t.batch_id = a.batch_id AND (a.field <> 'local_median' OR len(list_filter(a.conds, lambda c: (CASE split_part(c, '=', 1) {_DIM} END) = split_part(c, '=', 2))) = len(a.conds))
  UNION ALL SELECT a.*, CASE a.metric {_VALUE} END FROM asked a JOIN deliveries t ON a.batch_id IS NULL AND t.dataset_id = a.dataset_id),
ok AS (SELECT record_id, metric, field, v, x FROM hit WHERE x IS NOT NULL AND NOT isnan(x)),
mid AS (SELECT record_id, metric, v, median(x) AS m FROM ok WHERE field = 'global_mad' GROUP BY 1, 2, 3),
val AS (SELECT record_id, metric, field, v, x FROM ok WHERE field <> 'global_mad' UNION ALL SELECT ok.record_id, ok.metric, ok.field, ok.v, abs(x - m) FROM ok JOIN mid ON ok.record_id = mid.record_id AND ok.metric = mid.metric AND ok.v = mid.v WHERE field = 'global_mad')
SELECT DISTINCT record_id, metric, field FROM (SELECT record_id, metric, field, v FROM val GROUP BY 1, 2, 3, 4 {_WRONG})""",
    "p2_found": f"WITH {_UNIT}, p AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.v, b.v) AS c FROM u a JOIN u b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 12) DESC, b) AS r FROM p) SELECT DISTINCT least(a, b) AS insight_a, greatest(a, b) AS insight_b FROM r WHERE r <= 5 AND c >= 0.9",
    "p6_found": f"""WITH RECURSIVE {_UNIT}, k AS (SELECT id, v, list_filter(shifts, lambda s: s.robust_z IS NOT NULL AND NOT isnan(s.robust_z)) AS ok FROM u), p AS (SELECT id, v, list_filter(ok, lambda s: abs(s.robust_z) = list_max(list_transform(ok, lambda t: abs(t.robust_z))))[1] AS s FROM k WHERE len(ok) > 0),
e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.s.metric = b.s.metric AND (a.s.robust_z >= 0) = (b.s.robust_z >= 0) AND a.id <> b.id WHERE list_dot_product(a.v, b.v) >= 0.65),
w AS (SELECT id, id AS root FROM p UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.id), c AS (SELECT id, min(root) AS root FROM w GROUP BY 1)
SELECT id AS insight_id, root AS cluster_id FROM c WHERE root IN (SELECT root FROM c GROUP BY 1 HAVING count(*) >= 5)""",
}
