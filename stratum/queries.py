"""Driver-facing queries of the core operators, and their SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions import stats as S
from stratum.operators import anchors, discovery, graph, gridseries, instants, lattice, proximity, search, spatial, timeplane
from stratum.operators.components import connected_components
from stratum.plans import pipeline
from stratum.runtime import load
from stratum.sources import exports, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIMS = ["segment", "channel", "vehicle", "refunded", "area"]
METRICS = ["basket", "items", "wait_min", "rating"]


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- training-data problems of the core ----------------------------------------------------------


@query()
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return proximity.found_near_and_inside(load(spark, d, "layer_points"), load(spark, d, "zones"))


_LOCAL = "WITH u AS (SELECT DISTINCT source_id, lower(grid) AS grid, CASE lower(grid) WHEN 'day' THEN date_trunc('day', lt) WHEN 'week' THEN date_trunc('week', lt) WHEN 'month' THEN date_trunc('month', lt) ELSE date_trunc('quarter', lt) END::DATE AS p FROM (SELECT source_id, grid, read_at AT TIME ZONE coalesce(tz, 'UTC') AS lt FROM readings JOIN datasets USING (dataset_id) WHERE read_at IS NOT NULL AND value IS NOT NULL AND isfinite(value) AND lower(grid) IN ('day', 'week', 'month', 'quarter')))"


@query(_LOCAL + ", s AS (SELECT source_id, grid, min(p) AS a, max(p) AS b FROM u GROUP BY 1, 2), g AS (SELECT source_id, grid, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, CASE grid WHEN 'day' THEN INTERVAL 1 DAY WHEN 'week' THEN INTERVAL 7 DAY WHEN 'month' THEN INTERVAL 1 MONTH ELSE INTERVAL 3 MONTH END))::DATE AS p FROM s) SELECT source_id, p::VARCHAR AS period FROM g WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.source_id = g.source_id AND u.grid = g.grid AND u.p = g.p)")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return gridseries.missing_periods(load(spark, d, "readings"), load(spark, d, "datasets"))


@query()
def p4_grid(spark: SparkSession, d: str) -> DataFrame:
    return gridseries.regular_series(load(spark, d, "readings"), load(spark, d, "datasets"))


@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return instants.normalised(load(spark, d, "raw_times"), load(spark, d, "datasets")).select("row_id", "utc_us")


# --- wide fact of the star schema ----------------------------------------------------------------


def _fact(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    c = load(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    n = load(spark, d, "nation").select("n_nationkey", "n_regionkey")
    r = load(spark, d, "region").select("r_regionkey", "r_name")
    return li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)


FACT = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
FDIMS = ["l_returnflag", "l_linestatus", "o_orderpriority", "o_orderstatus", "c_mktsegment", "r_name"]
FMETRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice"]
FINITE = {m: f"CASE WHEN isnan({m}::DOUBLE) THEN NULL ELSE {m}::DOUBLE END" for m in METRICS}


def _long_sql(table: str, cols: list[str], metrics: list[str]) -> str:
    head = ", ".join(cols) + (", " if cols else "")
    return " UNION ALL ".join(f"SELECT {head}'{m}' AS metric, {m}::DOUBLE AS value FROM {table} WHERE {m} IS NOT NULL AND NOT isnan({m}::DOUBLE)" for m in metrics)


# --- 2.1 and 2.2: sources and projections --------------------------------------------------------


@query("SELECT segment, channel, count(*) AS n FROM deliveries WHERE area = 'metro 1' GROUP BY 1, 2")
def where_filter(spark, d):
    return files.filter_rows(load(spark, d, "deliveries").select("segment", "channel", "area"), "area=metro 1").groupBy("segment", "channel").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT rating, count(*) AS n FROM (SELECT coalesce(rating::VARCHAR, 'missing') AS rating FROM deliveries) GROUP BY 1")
def category_override(spark, d):
    return files.apply_categories(load(spark, d, "deliveries").select("rating"), ["rating"]).groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


@query("WITH e AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM lineitem) SELECT 'q' || (1 + (l_extendedprice > q[1])::INT + (l_extendedprice > q[2])::INT + (l_extendedprice > q[3])::INT) AS l_extendedprice_band, count(*) AS n FROM lineitem, e GROUP BY 1")
def quantile_bands(spark, d):
    return files.apply_bins(load(spark, d, "lineitem").select("l_extendedprice"), {"l_extendedprice": 4}).groupBy("l_extendedprice_band").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT area AS value, count(*) AS n, CASE WHEN count(*) >= 1000 THEN 'ok' ELSE 'sparse' END AS state FROM deliveries WHERE area IS NOT NULL GROUP BY 1")
def kept_values(spark, d):
    return files.value_counts(load(spark, d, "deliveries").select("area"), "area", 1000)


@query("SELECT point_id, lat, lon FROM (SELECT DISTINCT point_id, lat, lon FROM layer_points) WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND point_id IS NOT NULL")
def parsed_points(spark, d):
    p = load(spark, d, "layer_points").select("point_id", "lat", "lon").distinct().where("point_id is not null and lat is not null and lon is not null")
    text = F.when(F.col("point_id") % 2 == 0, F.concat(F.lit("POINT ("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")"))).otherwise(F.concat(F.lit('{"type":"Point","coordinates":['), F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("]}")))
    lat, lon = files.parse_points(F.col("t"))
    return p.withColumn("t", text).select("point_id", lat.alias("lat"), lon.alias("lon")).where("lat is not null")


@query("SELECT dataset_id, left(sha256(filename || '|' || grid || '|' || coalesce(tz, 'UTC')), 12) AS fingerprint FROM datasets")
def dataset_fingerprints(spark, d):
    return load(spark, d, "datasets").select("dataset_id", F.substring(F.sha2(F.concat_ws("|", "filename", "grid", F.coalesce("tz", F.lit("UTC"))), 256), 1, 12).alias("fingerprint"))


@query()
def cells_as_geojson(spark, d):
    p = load(spark, d, "deliveries").select("lat", "lon", "basket")
    return exports.cells_geojson(spatial.cell_table(p, "lat", "lon", 6, ["basket"]), "cell", ["cell", "events", "basket_median"])


@query()
def findings_as_turtle(spark, d):
    i = lattice.scopes(load(spark, d, "insights")).select("id", "batch_id", F.to_json("conds").alias("label"))
    at = load(spark, d, "deliveries").where("batch_id is not null").groupBy("batch_id").agg(F.min(spatial.cell_of(F.col("lat"), F.col("lon"), 4)).alias("cell")).where("cell is not null")
    return exports.turtle(i.join(at, "batch_id").select("id", "label", "cell"))


# --- 2.5: profile, dimensions, search space ------------------------------------------------------

_PCOLS = ["delivery_id", "batch_id", *DIMS, *METRICS]


@query(
    "WITH l AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS v FROM deliveries" for c in _PCOLS)
    + """), g AS (SELECT "column", v, count(*) AS n FROM l GROUP BY 1, 2)
SELECT "column", sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (v IS NOT NULL), 0)::BIGINT AS n_values, count(v) AS n_distinct, round(max(n) FILTER (v IS NOT NULL) / sum(n) FILTER (v IS NOT NULL), 6) AS top_share,
CASE WHEN count(v) = coalesce(sum(n) FILTER (v IS NOT NULL), 0) AND count(v) > 1 AND "column" NOT IN ('basket', 'wait_min') THEN 'identifier' WHEN count(v) <= 1 THEN 'constant' WHEN "column" IN ('delivery_id', 'basket', 'items', 'wait_min', 'rating') THEN 'metric' ELSE 'dimension' END AS role
FROM g GROUP BY 1"""
)
def profile(spark, d):
    return discovery.profile_columns(load(spark, d, "deliveries"), _PCOLS)


@query(
    "WITH c AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS dim, {c} AS level, count(*) AS n FROM deliveries WHERE {c} IS NOT NULL GROUP BY 2" for c in DIMS)
    + "), p AS (SELECT *, n / sum(n) OVER (PARTITION BY dim) AS p FROM c) SELECT dim, count(*) AS levels, round(-sum(p * log2(p)), 4) AS entropy FROM p GROUP BY 1"
)
def dimension_entropy(spark, d):
    return rounded(S.entropy(load(spark, d, "deliveries"), DIMS))


@query(
    "WITH p AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS pairs, count(DISTINCT x) AS nx, count(DISTINCT y) AS ny FROM (SELECT DISTINCT {a}::VARCHAR AS x, {b}::VARCHAR AS y FROM deliveries WHERE {a} IS NOT NULL AND {b} IS NOT NULL)" for i, a in enumerate(sorted(["area", "batch_id", "channel", "dataset_id"])) for b in sorted(["area", "batch_id", "channel", "dataset_id"])[i + 1 :])
    + ") SELECT a, b, pairs, pairs <= 1.10 * greatest(nx, ny) AS nested FROM p"
)
def nested_columns(spark, d):
    return discovery.nested_dimensions(load(spark, d, "deliveries"), ["area", "batch_id", "channel", "dataset_id"])


@query(f"SELECT a, b, round(r, 4) AS r, abs(r) > 0.95 AS colinear FROM ({' UNION ALL '.join(f'SELECT {chr(39)}{a}{chr(39)} AS a, {chr(39)}{b}{chr(39)} AS b, corr({a}, {b}) AS r FROM {FACT}' for i, a in enumerate(FMETRICS) for b in FMETRICS[i + 1 :])})")
def correlated_columns(spark, d):
    return rounded(discovery.correlated_metrics(_fact(spark, d), FMETRICS))


_POWER = f"""WITH l AS ({" UNION ALL ".join(f"SELECT '{k}' AS dim, {k}::VARCHAR AS level, '{m}' AS metric, {m}::DOUBLE AS y FROM {FACT}" for k in FDIMS for m in FMETRICS)}),
g AS (SELECT dim, metric, level, count(*) AS n, sum(y) AS s, sum(y * y) AS s2 FROM l GROUP BY 1, 2, 3),
t AS (SELECT dim, metric, sum(n) AS n, count(*) AS k, sum(s2) - sum(s) * sum(s) / sum(n) AS sst, sum(s * s / n) - sum(s) * sum(s) / sum(n) AS ssb FROM g GROUP BY 1, 2),
e AS (SELECT dim, avg(CASE WHEN sst > 0 AND n > k THEN greatest(0, ssb - (k - 1) * (sst - ssb) / (n - k)) / sst ELSE 0 END) AS power FROM t GROUP BY 1)"""


@query(_POWER + " SELECT dim, round(power, 5) AS power FROM e")
def dimension_power(spark, d):
    return rounded(discovery.dimension_power(_fact(spark, d), FDIMS, FMETRICS), 5)


@query(_POWER + ", r AS (SELECT *, row_number() OVER (ORDER BY power DESC, dim) AS rank, median(power) OVER () AS mid FROM e) SELECT dim, rank FROM r WHERE (power > mid AND rank <= 6) OR rank <= 3")
def chosen_dimensions(spark, d):
    return discovery.chosen_dimensions(discovery.dimension_power(_fact(spark, d), FDIMS, FMETRICS)).select("dim", "rank")


_LEVELS = " UNION ALL ".join(f"SELECT '{c}' AS dim, {c} AS level, count(*) AS n FROM deliveries WHERE {c} IS NOT NULL GROUP BY 2" for c in DIMS)


@query(f"WITH c AS ({_LEVELS}), x AS (SELECT *, n / sum(n) OVER (PARTITION BY dim) AS share, coalesce(sum(n) OVER (PARTITION BY dim ORDER BY n DESC, level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY dim) AS before FROM c) SELECT dim, level, n, round(share, 4) AS share FROM x WHERE before < 0.95")
def search_levels(spark, d):
    return rounded(discovery.levels_to_mass(S.level_counts(load(spark, d, "deliveries"), DIMS)))


@query(f"WITH l AS ({_long_sql('deliveries', [], METRICS)}), m AS (SELECT metric, count(*) AS n, median(value) AS median FROM l GROUP BY 1), dv AS (SELECT l.metric, median(abs(value - median)) AS mad0, avg(abs(value - median)) AS md FROM l JOIN m USING (metric) GROUP BY 1) SELECT metric, n, round(median, 4) AS median, round(CASE WHEN mad0 = 0 THEN 0.6745 / 0.7979 * md ELSE mad0 END, 4) AS mad FROM m JOIN dv USING (metric)")
def global_medians(spark, d):
    return rounded(S.global_stats(discovery.long_form(load(spark, d, "deliveries"), [], METRICS), ["metric"]))


_PAIRS = [(a, b) for i, a in enumerate(sorted(FDIMS)) for b in sorted(FDIMS)[i + 1 :]]
_CONJ = "WITH f AS (SELECT * FROM " + FACT + "), l AS (" + _long_sql("f", FDIMS, FMETRICS) + "), c AS (" + " UNION ALL ".join(f"SELECT '{a}==''' || {a} || ''' AND {b}==''' || {b} || '''' AS expression, metric, count(*) AS n, median(value) AS local_median FROM l GROUP BY {a}, {b}, metric" for a, b in _PAIRS) + ")"
_SLICE = (
    _CONJ
    + f""", k AS (SELECT c.*, (SELECT count(*) FROM f) AS total FROM c), g AS (SELECT metric, median(value) AS med FROM l GROUP BY 1), dv AS (SELECT l.metric, median(abs(value - med)) AS mad0, avg(abs(value - med)) AS md FROM l JOIN g USING (metric) GROUP BY 1),
z AS (SELECT expression, metric, n, total, (CASE WHEN local_median < med THEN -1 ELSE 1 END) * least(10, 0.6745 * abs(local_median - med) / (CASE WHEN mad0 = 0 THEN 0.6745 / 0.7979 * md ELSE mad0 END + 1e-6)) AS z FROM k JOIN g USING (metric) JOIN dv USING (metric) WHERE n >= greatest(5 * {len(FMETRICS)}, total // 200) AND n < total),
r AS (SELECT *, row_number() OVER (PARTITION BY expression ORDER BY abs(z) DESC, metric) AS r FROM z),
s AS (SELECT expression, max(n) AS n, sum(abs(z)) FILTER (r <= 3) AS sd, sqrt(max(n) / max(total)::DOUBLE) * (1 - max(n) / max(total)::DOUBLE) AS volume, max(metric) FILTER (r = 1) AS primary_metric, max(z) FILTER (r = 1) AS primary_z FROM r GROUP BY 1)"""
)


@query(_CONJ + " SELECT expression, metric, n, round(local_median, 4) AS local_median FROM c")
def conjunction_medians(spark, d):
    return rounded(discovery.conjunctions(_fact(spark, d), FDIMS, FMETRICS))


@query(_SLICE + " SELECT expression, n, round(sd, 4) AS sd, round(volume, 4) AS volume, primary_metric, round(primary_z, 4) + 0.0 AS primary_z FROM s")
def cohort_slices(spark, d):
    return rounded(discovery.slices(_fact(spark, d), FDIMS, FMETRICS))


_RANK = ", x AS (SELECT *, greatest(0, coalesce((sd - avg(sd) OVER ()) / nullif(stddev_pop(sd) OVER (), 0), 0)) + greatest(0, coalesce((volume - avg(volume) OVER ()) / nullif(stddev_pop(volume) OVER (), 0), 0)) AS ti FROM s), y AS (SELECT *, row_number() OVER (ORDER BY round(ti, 9) DESC, expression) AS rank FROM x)"


@query(_SLICE + _RANK + " SELECT expression, n, round(ti, 4) AS temp_index, rank FROM y WHERE rank <= 50")
def ranked_cohorts(spark, d):
    return rounded(discovery.ranked_slices(discovery.slices(_fact(spark, d), FDIMS, FMETRICS)).select("expression", "n", "temp_index", "rank"))


_SETS = [(a, b) for a, b in _PAIRS] + [(a, b, c) for i, a in enumerate(sorted(FDIMS)) for j, b in enumerate(sorted(FDIMS)[i + 1 :], i + 1) for c in sorted(FDIMS)[j + 1 :]]
_KEPT_LEVELS = "lv AS (" + " UNION ALL ".join(f"SELECT '{k}' AS dim, {k}::VARCHAR AS level, count(*) AS n FROM f WHERE {k} IS NOT NULL GROUP BY 2" for k in FDIMS) + "), kp AS (SELECT dim, level FROM (SELECT dim, level, coalesce(sum(n) OVER (PARTITION BY dim ORDER BY n DESC, level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY dim) AS b FROM lv) WHERE b < 0.95)"
_INTENT = "concat_ws(' AND ', " + ", ".join(f"CASE WHEN count({k}) = count(*) AND min({k}) = max({k}) THEN '{k}==''' || min({k}) || '''' END" for k in sorted(FDIMS)) + ")"
_MPAIRS = [(a, b) for i, a in enumerate(FMETRICS) for b in FMETRICS[i + 1 :]]
_CLOSED = (
    "WITH r AS (SELECT * FROM "
    + FACT
    + "), f AS (SELECT *, "
    + ", ".join(f"rank() OVER (ORDER BY {m}) + (count(*) OVER (PARTITION BY {m}) - 1) / 2 AS r_{m}" for m in FMETRICS)
    + f" FROM r), {_KEPT_LEVELS}, g AS ("
    + " UNION ALL ".join(
        "SELECT "
        + " || ' AND ' || ".join(f"'{k}==''' || {k} || ''''" for k in s)
        + f" AS expression, {len(s)} AS size, count(*) AS n, {_INTENT} AS intent, "
        + ", ".join([f"median({m}) AS m_{m}" for m in FMETRICS] + [f"corr(r_{a}, r_{b}) AS c_{a}_{b}" for a, b in _MPAIRS])
        + " FROM f WHERE "
        + " AND ".join(f"{k} IN (SELECT level FROM kp WHERE dim = '{k}')" for k in s)
        + " GROUP BY "
        + ", ".join(s)
        for s in _SETS
    )
    + f"), t AS (SELECT count(*) AS total, greatest({5 * len(FMETRICS)}, count(*) // 200) AS least FROM f), h AS (SELECT g.*, count(*) OVER (PARTITION BY intent) - 1 AS n_aliases, row_number() OVER (PARTITION BY intent ORDER BY size DESC, expression) AS head FROM g, t WHERE n >= least AND n < total), one AS (SELECT * FROM h WHERE head = 1)"
)
_SCORES = (
    f", gm AS (SELECT {', '.join([f'median({m}) AS g_{m}' for m in FMETRICS] + [f'corr(r_{a}, r_{b}) AS gc_{a}_{b}' for a, b in _MPAIRS])} FROM f), "
    f"gd AS (SELECT {', '.join(f'CASE WHEN median(abs({m} - g_{m})) = 0 THEN 0.6745 / 0.7979 * avg(abs({m} - g_{m})) ELSE median(abs({m} - g_{m})) END AS d_{m}' for m in FMETRICS)} FROM f, gm), "
    f"z AS (SELECT expression, n, list_sort([{', '.join(f'least(10, 0.6745 * abs(m_{m} - g_{m}) / (d_{m} + 1e-6))' for m in FMETRICS)}], 'DESC') AS z, sqrt(2 * ({' + '.join(f'coalesce(pow(gc_{a}_{b} - c_{a}_{b}, 2), 0)' for a, b in _MPAIRS)}) / {len(FMETRICS) * (len(FMETRICS) - 1)}) AS change, n / total AS p, total, least FROM one, gm, gd, t), "
    f"s AS (SELECT expression, n, z[1] + z[2] + z[3] AS sd, CASE WHEN n >= {3 * len(FMETRICS)} THEN change * sqrt(greatest(0, n - least) / (total - least)) ELSE 0 END AS emm, sqrt(p) * (1 - p) AS volume FROM z)"
)
_TEMP = " + ".join(f"greatest(0, coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0))" for c in ("sd", "emm", "volume"))


@query(_CLOSED + " SELECT expression, intent, n, n_aliases FROM one")
def closed_cohorts(spark, d):
    q = search.cube(_fact(spark, d), FDIMS, FMETRICS)
    heads, _ = search.closed_cohorts(q, search.search_space(q))
    return heads.select("expression", "intent", "n", F.size("aliases").cast("bigint").alias("n_aliases"))


@query(_CLOSED + _SCORES + f" SELECT expression, n, round(sd, 4) AS sd, round(emm, 4) AS emm, round(volume, 4) AS volume, round({_TEMP}, 4) AS temp_index FROM s")
def scored_cohorts(spark, d):
    q = search.cube(_fact(spark, d), FDIMS, FMETRICS)
    heads, extents = search.closed_cohorts(q, search.search_space(q))
    return rounded(search.scored(q, heads, extents)[0].select("expression", "n", "sd", "emm", "volume", "temp_index"))


@query()
def mined_findings(spark, d):
    return search.mine(_fact(spark, d), FDIMS, FMETRICS)


_COVER = "SELECT l_orderkey * 16 + l_linenumber AS row_id, UNNEST([" + ", ".join(f"'{a}==''' || {a} || ''' AND {b}==''' || {b} || ''''" for a, b in _PAIRS) + f"]) AS expression FROM {FACT}"


@query(f"WITH c AS ({_COVER}), h AS (SELECT expression, count(*) AS n, md5(string_agg(row_id::VARCHAR, ',' ORDER BY row_id)) AS h FROM c GROUP BY 1) SELECT n, min(expression) AS head, count(*) AS members FROM h GROUP BY n, h")
def identical_extents(spark, d):
    f = _fact(spark, d).withColumn("row_id", F.col("l_orderkey") * 16 + F.col("l_linenumber"))
    return discovery.identical_extents(discovery.extents(f, "row_id", FDIMS))


@query(f"WITH c AS ({_COVER}), k AS (SELECT * FROM c WHERE expression LIKE '%l_returnflag%'), n AS (SELECT expression, count(*) AS n FROM k GROUP BY 1), b AS (SELECT x.expression AS a, y.expression AS b, count(*) AS i FROM k x JOIN k y ON x.row_id = y.row_id AND x.expression < y.expression GROUP BY 1, 2) SELECT a, b, round(i / (na.n + nb.n - i), 4) AS jaccard FROM b JOIN n na ON a = na.expression JOIN n nb ON b = nb.expression WHERE i / (na.n + nb.n - i) >= 0.3")
def near_duplicate_extents(spark, d):
    f = _fact(spark, d).withColumn("row_id", F.col("l_orderkey") * 16 + F.col("l_linenumber"))
    return rounded(discovery.extent_overlaps(discovery.extents(f, "row_id", FDIMS).where("expression like '%l_returnflag%'"), 0.3))


@query()
def overlapping_extents(spark, d):
    """All overlapping pairs of conjunctions; ``near_duplicate_extents`` and its twin hold those in which both name l_returnflag."""
    f = _fact(spark, d).withColumn("row_id", F.col("l_orderkey") * 16 + F.col("l_linenumber"))
    return rounded(discovery.conjunction_overlaps(f, "row_id", FDIMS, least=0.3))


_AVG_RANK = "SELECT *, rank() OVER (ORDER BY {m}) + (count(*) OVER (PARTITION BY {m}) - 1) / 2 AS r_{m} FROM "


@query("WITH a AS (SELECT *, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS ra, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2 AS rb FROM lineitem), g AS (SELECT corr(ra, rb) AS g FROM a) SELECT l_returnflag AS level, 'l_quantity' AS a, 'l_discount' AS b, round(corr(ra, rb), 4) + 0.0 AS \"local\", round(g, 4) + 0.0 AS \"global\", round(g - corr(ra, rb), 4) + 0.0 AS delta FROM a, g GROUP BY l_returnflag, g")
def correlation_change(spark, d):
    return rounded(discovery.correlation_change(load(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_discount"), "l_returnflag", ["l_quantity", "l_discount"]))


@query("WITH l AS (" + " UNION ALL ".join(f"SELECT basket > 40 AS i, '{c}' AS dim, {c} AS level FROM deliveries WHERE basket IS NOT NULL AND NOT isnan(basket) AND {c} IS NOT NULL" for c in DIMS) + "), c AS (SELECT dim, level, count(*) FILTER (i) AS a, count(*) FILTER (NOT i) AS b FROM l GROUP BY 1, 2), p AS (SELECT dim, level, a / sum(a) OVER (PARTITION BY dim) AS p, b / sum(b) OVER (PARTITION BY dim) AS q FROM c) SELECT dim, round(sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) / 2 ELSE 0 END))), 4) AS js, round(max(p - q), 4) AS gain FROM p GROUP BY 1")
def confounders(spark, d):
    t = load(spark, d, "deliveries").where("basket is not null and not isnan(basket)")
    return rounded(discovery.drivers(t, F.col("basket") > 40, DIMS).select("dim", "js", "gain"))


@query("WITH x AS (SELECT segment, basket AS v, items AS w FROM deliveries WHERE basket IS NOT NULL AND NOT isnan(basket) AND items > 0), p AS (SELECT segment, v, sum(w) AS w, sum(w * w) AS w2 FROM x GROUP BY 1, 2), u AS (SELECT *, sum(w) OVER (PARTITION BY segment ORDER BY v) AS up, sum(w) OVER (PARTITION BY segment) AS tot FROM p) SELECT segment, round(sum(w) * sum(w) / sum(w2)::DOUBLE, 2) AS n_eff, min(v) FILTER (up * 2 >= tot) AS median FROM u GROUP BY 1")
def weighted_medians(spark, d):
    return rounded(S.weighted_median(load(spark, d, "deliveries").select("segment", "basket", "items"), ["segment"], "basket", "items"), 2).withColumn("median", F.col("median"))


def _erfc_sql(x: str) -> str:
    t = f"(1 / (1 + ({x}) / 2))"
    poly = str(S.ERFC[-1])
    for c in reversed(S.ERFC[:-1]):
        poly = f"({c} + {t} * {poly})"
    return f"({t} * exp({poly} - ({x}) * ({x})))"


@query(f"WITH t AS (SELECT area, basket FROM deliveries WHERE area IS NOT NULL AND basket IS NOT NULL AND NOT isnan(basket)), g AS (SELECT median(basket) AS m FROM t), c AS (SELECT area, count(*) AS n, median(basket) AS lm FROM t GROUP BY 1), dv AS (SELECT t.area, median(abs(basket - lm)) AS ml FROM t JOIN c USING (area) GROUP BY 1), z AS (SELECT area, n, (lm - m) / (1.2533 * 1.4826 * ml / sqrt(n)) AS z FROM c JOIN dv USING (area), g) SELECT area, n, round(z, 4) AS z, round({_erfc_sql('abs(z) / 1.4142135623730951')}, 6) AS p FROM z")
def median_tests(spark, d):
    t = load(spark, d, "deliveries").where("area is not null and basket is not null and not isnan(basket)").select("area", "basket")
    c = t.groupBy("area").agg(F.count(F.lit(1)).alias("n"), F.median("basket").alias("lm"))
    dv = t.join(F.broadcast(c), "area").groupBy("area").agg(F.median(F.abs(F.col("basket") - F.col("lm"))).alias("ml"))
    z = c.join(dv, "area").crossJoin(F.broadcast(t.agg(F.median("basket").alias("m")))).withColumn("z", S.median_test_z(F.col("lm"), F.col("m"), F.col("ml"), F.lit(1.0), F.lit(1.0), F.col("n")))
    return z.select("area", "n", F.round("z", 4).alias("z"), F.round(S.two_sided(F.col("z")), 6).alias("p"))


@query("WITH p AS (SELECT l_partkey AS k, 1.0 / (1 + count(*)) AS p FROM lineitem GROUP BY 1), r AS (SELECT k, p, row_number() OVER (ORDER BY p, k) AS r, count(*) OVER () AS m FROM p) SELECT k, round(least(1, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r")
def benjamini_hochberg(spark, d):
    p = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg((1.0 / (1 + F.count(F.lit(1)))).alias("p"))
    return S.benjamini_hochberg(p.orderBy("p", "k"), "p", []).select("k", F.round("q", 6).alias("q"))


# --- 2.3: selection, weights, admission ----------------------------------------------------------

_INS = "(SELECT DISTINCT ON (id) * FROM insights WHERE id IS NOT NULL)"
_PRIM = "list_sort(list_transform(list_filter(shifts, lambda s: s.robust_z IS NOT NULL AND NOT isnan(s.robust_z)), lambda s: abs(s.robust_z)), 'DESC')[1]"


@query(f"WITH w AS (SELECT id, batch_id, {_PRIM} AS z, sqrt(support_fraction) * (1 - support_fraction) AS vol FROM {_INS}) SELECT id, round(0.05 + 0.95 * CASE WHEN z IS NULL AND vol IS NULL THEN 0 ELSE exp(((CASE WHEN z IS NOT NULL THEN 0.35 * ln(greatest(1 - exp(-z / 1.5), 1e-3)) ELSE 0 END) + (CASE WHEN vol IS NOT NULL THEN 0.1 * ln(greatest(vol / 0.3849, 1e-3)) ELSE 0 END)) / ((CASE WHEN z IS NOT NULL THEN 0.35 ELSE 0 END) + (CASE WHEN vol IS NOT NULL THEN 0.1 ELSE 0 END))) END, 4) AS weight FROM w")
def insight_weights(spark, d):
    i = load(spark, d, "insights").where("id is not null").dropDuplicates(["id"])
    z = lattice.primary_shift(F.col("shifts"))["robust_z"]
    vol = F.sqrt("support_fraction") * (1 - F.col("support_fraction"))
    none = F.lit(None).cast("double")
    return i.select("id", F.round(S.insight_weight(z, none, vol, none), 4).alias("weight"))


@query(f"WITH r AS (SELECT id, batch_id, weight, CASE WHEN weight >= 0.2 THEN row_number() OVER (PARTITION BY batch_id, weight >= 0.2 ORDER BY weight DESC, id) END AS rank FROM {_INS} WHERE weight IS NOT NULL) SELECT id, rank, CASE WHEN weight < 0.2 THEN 'low_weight' WHEN rank > 20 THEN 'budget' END AS reason FROM r")
def admitted_insights(spark, d):
    i = load(spark, d, "insights").where("id is not null and weight is not null").dropDuplicates(["id"]).select("id", "batch_id", "weight")
    return discovery.admit(i, budget=20).select("id", "rank", "reason")


# --- 2.4: relations between findings -------------------------------------------------------------

_SC = f"sc AS (SELECT id, batch_id, dataset_id, list_sort(list_distinct(coalesce(list_transform(conditions, lambda c: c.attribute || '=' || c.value), []))) AS conds, shifts, support, weight FROM {_INS})"


@query(f"WITH {_SC}, up AS (SELECT c.id AS child, p.id AS parent FROM sc c JOIN sc p ON c.batch_id = p.batch_id AND len(p.conds) < len(c.conds) AND list_has_all(c.conds, p.conds)) SELECT child, parent FROM up u WHERE NOT EXISTS (SELECT 1 FROM up a JOIN up b ON a.parent = b.child WHERE a.child = u.child AND b.parent = u.parent)")
def specialisations(spark, d):
    return lattice.specialisations(lattice.scopes(load(spark, d, "insights")))


_SIB = f"{_SC}, x AS (SELECT id, batch_id, c, split_part(c, '=', 1) AS attribute, list_filter(conds, lambda e: e <> c) AS rest FROM (SELECT id, batch_id, conds, unnest(conds) AS c FROM sc)), sib AS (SELECT a.id AS a, b.id AS b, a.attribute FROM x a JOIN x b ON a.batch_id = b.batch_id AND a.attribute = b.attribute AND a.rest = b.rest WHERE a.id < b.id AND a.c <> b.c)"


@query(f"WITH {_SIB} SELECT a, b, attribute FROM sib")
def siblings(spark, d):
    return lattice.siblings(lattice.scopes(load(spark, d, "insights")))


@query(f"WITH {_SIB}, sh AS (SELECT id, s.metric AS metric, s.robust_z AS z FROM (SELECT id, unnest(shifts) AS s FROM sc) WHERE s.robust_z IS NOT NULL AND NOT isnan(s.robust_z)), m AS (SELECT id, metric, arg_max(z, abs(z)) AS z FROM sh GROUP BY 1, 2), p AS (SELECT DISTINCT a, b FROM sib), c AS (SELECT p.a, p.b, x.metric, least(abs(x.z), abs(y.z)) AS s FROM p JOIN m x ON p.a = x.id JOIN m y ON p.b = y.id AND x.metric = y.metric WHERE x.z * y.z < 0), r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY s DESC, metric DESC) AS r FROM c WHERE s >= 0.3) SELECT a, b, metric, round(s, 4) AS strength FROM r WHERE r = 1")
def contrasts(spark, d):
    s = lattice.scopes(load(spark, d, "insights"))
    return rounded(lattice.contrasts(lattice.siblings(s).select("a", "b").distinct(), s, 0.3))


@query(f"WITH {_INS[1:-1].replace('SELECT', 'i AS (SELECT', 1)}), s AS (SELECT id, dataset_id, list_sort(list_transform(conditions, lambda c: c.attribute || '=' || c.value)) AS scope, unnest(shifts) AS s FROM i), f AS (SELECT id, dataset_id, scope, s.metric AS metric, sign(s.robust_z) AS sg FROM s WHERE s.robust_z IS NOT NULL AND NOT isnan(s.robust_z)), w AS (SELECT metric, sg, count(DISTINCT dataset_id) AS n FROM f GROUP BY 1, 2), a AS (SELECT metric, sg, scope, count(DISTINCT dataset_id) AS n FROM f GROUP BY 1, 2, 3) SELECT f.id, max(w.n - 1) AS others, min(CASE WHEN a.n > 1 THEN 1 WHEN w.n > 1 THEN 2 ELSE 6 END) AS level FROM f JOIN w ON f.metric = w.metric AND f.sg = w.sg JOIN a ON f.metric = a.metric AND f.sg = a.sg AND f.scope IS NOT DISTINCT FROM a.scope GROUP BY 1")
def credibility(spark, d):
    return graph.credibility(load(spark, d, "insights"))


@query("SELECT vec_id, 'changed' AS change FROM embeddings WHERE vec_id % 7 = 0 UNION ALL SELECT vec_id, 'gone' FROM embeddings WHERE vec_id % 7 = 1 UNION ALL SELECT vec_id + 1000000, 'added' FROM embeddings WHERE vec_id % 7 = 2")
def mirror_changes(spark, d):
    v = load(spark, d, "embeddings").select("vec_id", "label")
    new = v.where("vec_id % 7 <> 1").withColumn("label", F.when(F.col("vec_id") % 7 == 0, F.col("label") + 1).otherwise(F.col("label"))).unionByName(v.where("vec_id % 7 = 2").withColumn("vec_id", F.col("vec_id") + 1000000))
    return lattice.changed_rows(v, new, "vec_id")


# --- 2.5, 2.6: the time plane --------------------------------------------------------------------

_EV = "(SELECT event_type, value, date_trunc('week', ts)::DATE AS period FROM events WHERE ts IS NOT NULL)"


@query("WITH p AS (SELECT date_trunc('week', ts)::DATE AS p, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1), b AS (SELECT unnest(generate_series((SELECT min(p) FROM p)::TIMESTAMP, (SELECT max(p) FROM p)::TIMESTAMP, INTERVAL 7 DAY))::DATE AS p) SELECT b.p::VARCHAR AS period, coalesce(n, 0) AS n FROM b LEFT JOIN p ON b.p = p.p")
def calendar_bins(spark, d):
    return timeplane.calendar_bins(load(spark, d, "events"), "ts", "week").select(F.col("period").cast("string").alias("period"), "n")


@query(f"WITH g AS (SELECT event_type, period, count(*) AS n FROM {_EV} GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY period) - n AS rest FROM g) SELECT event_type AS pattern, period::VARCHAR AS period, n, round(ln((n + 0.5) / (rest + 0.5)), 4) AS log_ratio FROM t WHERE event_type IS NOT NULL")
def count_series(spark, d):
    s = timeplane.count_series(load(spark, d, "events"), "event_type", "ts", "week")
    return rounded(s.withColumn("period", F.col("period").cast("string")))


def _series(spark, d):
    return timeplane.series(load(spark, d, "events").select("event_type", "ts", "value"), "event_type", "ts", "week", "value", 10)


_SER = f"e AS (SELECT * FROM {_EV} WHERE value IS NOT NULL AND NOT isnan(value)), g AS (SELECT median(value) AS m FROM e), sc AS (SELECT CASE WHEN median(abs(value - m)) = 0 THEN 0.6745 / 0.7979 * avg(abs(value - m)) ELSE median(abs(value - m)) END / 0.6745 AS scale FROM e, g), mine AS (SELECT event_type, period, count(*) AS n, median(value) AS c, stddev_samp(value) AS sd FROM e WHERE event_type IS NOT NULL GROUP BY 1, 2), rest AS (SELECT a.event_type, a.period, count(*) AS rn, median(b.value) AS rc, stddev_samp(b.value) AS rsd FROM mine a JOIN e b ON a.period = b.period AND b.event_type IS DISTINCT FROM a.event_type GROUP BY 1, 2), ser AS (SELECT m.event_type AS pattern, m.period, m.n, CASE WHEN m.n >= 10 AND rn >= 10 THEN (c - rc) / scale END AS z, CASE WHEN m.n >= 10 AND rn >= 10 THEN sqrt(pow(1.2533 * sd, 2) / m.n + pow(1.2533 * rsd, 2) / rn) / scale END AS se FROM mine m LEFT JOIN rest r ON m.event_type = r.event_type AND m.period = r.period, sc)"


@query(f"WITH {_SER} SELECT pattern, period::VARCHAR AS period, n, round(z, 4) + 0.0 AS z, round(se, 4) AS se FROM ser")
def value_series(spark, d):
    return rounded(_series(spark, d).withColumn("period", F.col("period").cast("string")))


@query()
def series_dynamics(spark, d):
    return timeplane.dynamics(_series(spark, d))


@query(f"WITH b AS (SELECT event_type AS pattern, period, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY period) AS i FROM {_EV} WHERE event_type IS NOT NULL GROUP BY 1, 2), u AS (SELECT *, sum(n) OVER (PARTITION BY pattern ORDER BY period) AS up, sum(n) OVER (PARTITION BY pattern) AS tot FROM b), r AS (SELECT a.pattern, a.period AS first, z.period AS last, z.i - a.i AS d, a.i AS i0, row_number() OVER (PARTITION BY a.pattern ORDER BY z.i - a.i, a.i) AS r FROM u a JOIN u z ON a.pattern = z.pattern AND z.i >= a.i WHERE z.up - (a.up - a.n) >= 0.8 * z.tot) SELECT pattern, first::VARCHAR AS first, last::VARCHAR AS last, d + 1 AS bins FROM r WHERE r = 1")
def core_spans(spark, d):
    b = load(spark, d, "events").where("event_type is not null and ts is not null").select(F.col("event_type").alias("pattern"), F.trunc("ts", "WEEK").alias("period")).groupBy("pattern", "period").agg(F.count(F.lit(1)).alias("n"))
    return timeplane.core_span(b).select("pattern", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), "bins")


@query("WITH s AS (SELECT source_id AS pattern, date_trunc('week', read_at AT TIME ZONE 'UTC')::DATE AS period, max(CASE WHEN isnan(value) THEN NULL ELSE value END) AS v, max(value) FILTER (value > 20 AND NOT isnan(value)) AS z FROM readings WHERE read_at IS NOT NULL GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY period) AS i FROM s), g AS (SELECT pattern, period, i - row_number() OVER (PARTITION BY pattern ORDER BY period) AS g FROM n WHERE z IS NULL) SELECT pattern, min(period)::VARCHAR AS first, max(period)::VARCHAR AS last, count(*) AS bins FROM g GROUP BY pattern, g")
def gap_runs(spark, d):
    s = load(spark, d, "readings").where("read_at is not null").groupBy(F.col("source_id").alias("pattern"), F.trunc("read_at", "WEEK").alias("period")).agg(F.max(F.when((F.col("value") > 20) & ~F.isnan("value"), F.col("value"))).alias("z"))
    return timeplane.gaps(s).select("pattern", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), "bins")


@query("WITH t AS (SELECT DISTINCT (created_at AT TIME ZONE 'UTC')::DATE AS d FROM insights) SELECT d::VARCHAR AS day, strftime(d, '%G-W%V') AS week, strftime(d, '%Y-%m') AS month, year(d) || '-Q' || quarter(d) AS quarter, date_trunc('month', date_trunc('week', d) + INTERVAL 3 DAY)::DATE::VARCHAR AS week_parent FROM t WHERE d IS NOT NULL")
def period_labels(spark, d):
    t = load(spark, d, "insights").select(F.to_date("created_at").alias("d")).where("d is not null").distinct()
    return t.select(F.col("d").cast("string").alias("day"), timeplane.period_label(F.col("d"), "week").alias("week"), timeplane.period_label(F.col("d"), "month").alias("month"), timeplane.period_label(F.col("d"), "quarter").alias("quarter"), timeplane.parent_period(F.trunc("d", "WEEK"), "week").cast("string").alias("week_parent"))


@query(f"SELECT id, round(pow(0.5, greatest(0, date_diff('day', (created_at AT TIME ZONE 'UTC')::DATE, DATE '2025-12-31')) / 90.0), 6) AS recency FROM {_INS}")
def recency(spark, d):
    i = load(spark, d, "insights").where("id is not null").dropDuplicates(["id"])
    return i.select("id", F.round(timeplane.recency(F.datediff(F.lit("2025-12-31").cast("date"), F.to_date("created_at")), 90.0), 6).alias("recency"))


@query(f"WITH e AS (SELECT id AS pattern, batch_id, s.metric AS metric, CASE WHEN s.robust_z >= 0 THEN 'peak' ELSE 'dip' END AS kind FROM (SELECT id, batch_id, unnest(shifts) AS s FROM {_INS}) WHERE abs(s.robust_z) >= 0.5), {_SC}, j AS (SELECT a.pattern, a.batch_id, a.metric, a.kind, b.pattern AS o, len(y.conds) AS k, y.support AS sup FROM e a JOIN e b ON a.batch_id = b.batch_id AND a.metric = b.metric AND a.kind = b.kind JOIN sc x ON x.id = a.pattern JOIN sc y ON y.id = b.pattern WHERE len(y.conds) < len(x.conds) AND list_has_all(x.conds, y.conds)), r AS (SELECT *, row_number() OVER (PARTITION BY pattern, batch_id, metric, kind ORDER BY k, sup DESC, o) AS r FROM j) SELECT pattern, batch_id AS period, metric, kind, o AS \"of\" FROM r WHERE r = 1")
def echoes(spark, d):
    i = load(spark, d, "insights").where("id is not null").dropDuplicates(["id"])
    e = i.select(F.col("id").alias("pattern"), F.col("batch_id").alias("period"), F.explode("shifts").alias("s")).where("abs(s.robust_z) >= 0.5").select("pattern", "period", "s.metric", F.when(F.col("s.robust_z") >= 0, "peak").otherwise("dip").alias("kind"))
    return timeplane.echoes(e, lattice.scopes(i).select("id", F.col("conds").alias("conditions"), "support"))


# --- cells and regions ---------------------------------------------------------------------------


def _cell_sql(lat: str, lon: str, res: int) -> tuple[str, str]:
    """Axial coordinates of a point in SQL: the same cube rounding."""
    s = spatial.edge(res)
    q, r = f"((0.5773502691896257 * {lon} - {lat} / 3) / {s})", f"((0.6666666666666666 * {lat}) / {s})"
    y = f"(-{q} - {r})"
    rq, rr, ry = f"floor({q} + 0.5)", f"floor({r} + 0.5)", f"floor({y} + 0.5)"
    dq, dr, dy = f"abs({rq} - {q})", f"abs({rr} - {r})", f"abs({ry} - {y})"
    first = f"({dq} > {dr} AND {dq} > {dy})"
    return f"(CASE WHEN {first} THEN -{rr} - {ry} ELSE {rq} END)::BIGINT", f"(CASE WHEN {first} THEN {rr} WHEN {dr} > {dy} THEN -{rq} - {ry} ELSE {rr} END)::BIGINT"


_RES = 8
_Q, _R = _cell_sql("lat", "lon", _RES)
_IN = "lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180"
_CELLS = f"pt AS (SELECT *, {_Q} AS q, {_R} AS r FROM deliveries WHERE {_IN}), cl AS (SELECT q, r, '{_RES}:' || q || ':' || r AS cell, count(*) AS events, CASE WHEN count(*) >= 5 THEN median(CASE WHEN isnan(basket) THEN NULL ELSE basket END) END AS basket_median FROM pt GROUP BY 1, 2), nb AS (SELECT a.cell, b.cell AS nbr FROM cl a JOIN cl b ON (b.q - a.q, b.r - a.r) IN ((1,0), (1,-1), (0,-1), (-1,0), (-1,1), (0,1)))"


def _cells(spark, d):
    return spatial.cell_table(load(spark, d, "deliveries").select("lat", "lon", "basket"), "lat", "lon", _RES, ["basket"])


@query(f"WITH {_CELLS} SELECT cell, events, round(basket_median, 4) AS basket_median FROM cl")
def cell_table(spark, d):
    return rounded(_cells(spark, d))


@query(f"WITH {_CELLS} SELECT cell, nbr FROM nb")
def cell_neighbours(spark, d):
    return spatial.neighbour_graph(_cells(spark, d))


@query(f"WITH {_CELLS}, l AS (SELECT nb.cell, avg(c.events) AS lag FROM nb JOIN cl c ON nb.nbr = c.cell GROUP BY 1) SELECT cl.cell, cl.events, round(l.lag, 4) AS lag FROM cl LEFT JOIN l USING (cell)")
def spatial_lags(spark, d):
    c = _cells(spark, d).select("cell", "events")
    return rounded(spatial.spatial_lag(c, spatial.neighbour_graph(c), "events"))


@query(f"WITH {_CELLS}, z AS (SELECT cell, events - (SELECT avg(events) FROM cl) AS z FROM cl), l AS (SELECT nb.cell, avg(z.z) AS lag FROM nb JOIN z ON nb.nbr = z.cell GROUP BY 1) SELECT count(*) AS n, round(count(*) / count(lag) * sum(z * lag) / sum(z * z), 4) AS moran FROM z LEFT JOIN l USING (cell)")
def global_moran(spark, d):
    c = _cells(spark, d).select("cell", "events")
    return rounded(spatial.moran_i(c, spatial.neighbour_graph(c), "events"))


@query(f"WITH {_CELLS}, m AS (SELECT avg(events) AS a, stddev_pop(events) AS s, count(*) AS n FROM cl), z AS (SELECT cell, n, (events - a) / s AS z FROM cl, m), l AS (SELECT nb.cell, avg(z.z) AS lag, count(*) AS k FROM nb JOIN z ON nb.nbr = z.cell GROUP BY 1), x AS (SELECT z.cell, z, lag, -z / (n - 1) AS e, ((n - z * z) / (n - 1) - (z / (n - 1)) * (z / (n - 1))) / k * (n - 1 - k) / (n - 2) AS v FROM z JOIN l USING (cell)) SELECT cell, round(z, 4) AS z, round(lag, 4) + 0.0 AS lag, round(CASE WHEN v > 0 THEN (lag - e) / sqrt(v) ELSE 0 END, 3) + 0.0 AS score FROM x")
def local_moran(spark, d):
    c = _cells(spark, d).select("cell", "events")
    x = spatial.local_moran(c, spatial.neighbour_graph(c), "events")
    return x.select("cell", F.round("z", 4).alias("z"), (F.round("lag", 4) + F.lit(0.0)).alias("lag"), (F.round("score", 3) + F.lit(0.0)).alias("score"))


_PLAT, _PLON = f"({spatial.edge(_RES)} * 1.5 * r)", f"({spatial.edge(_RES)} * 1.7320508075688772 * (q + r / 2))"
_PQ, _PR = _cell_sql(_PLAT, _PLON, 5)
_COV = f"{_CELLS}, co AS (SELECT DISTINCT segment AS pattern, '{_RES}:' || q || ':' || r AS cell, q, r FROM pt WHERE segment IS NOT NULL), rg AS (SELECT cell, '5:' || {_PQ} || ':' || {_PR} AS region FROM cl)"


def _cover(spark, d, by="segment"):
    p = load(spark, d, "deliveries").select("lat", "lon", by).withColumn("cell", spatial.cell_of(F.col("lat"), F.col("lon"), _RES))
    return p.where(f"cell is not null and {by} is not null").select(F.col(by).alias("pattern"), "cell").distinct()


@query(f"WITH {_COV} SELECT cell, region FROM rg")
def cell_parents(spark, d):
    return _cells(spark, d).select("cell", spatial.parent(F.col("cell"), 5).alias("region"))


@query(f"WITH {_COV}, s AS (SELECT pattern, count(*) AS size FROM co GROUP BY 1), o AS (SELECT region, count(*) AS occ FROM rg GROUP BY 1), g AS (SELECT pattern, region, count(*) AS n FROM co JOIN rg USING (cell) GROUP BY 1, 2) SELECT pattern, region, n, round(n / least(size, occ), 4) AS share FROM g JOIN s USING (pattern) JOIN o USING (region) WHERE n / least(size, occ) >= 0.2")
def region_membership(spark, d):
    return rounded(spatial.in_region(_cover(spark, d), _cells(spark, d).select("cell"), 5))


@query(f"WITH {_COV} SELECT pattern, count(*) AS links, count(i.cell) AS inside, round(count(i.cell) / count(*), 4) AS compactness FROM co JOIN nb USING (cell) LEFT JOIN (SELECT pattern AS p, cell FROM co) i ON i.p = co.pattern AND i.cell = nb.nbr GROUP BY 1")
def compactness(spark, d):
    return rounded(spatial.compactness(_cover(spark, d), spatial.neighbour_graph(_cells(spark, d).select("cell"))))


@query(f"WITH {_COV}, n AS (SELECT segment AS pattern, '{_RES}:' || q || ':' || r AS cell, count(*) AS n FROM pt WHERE segment IS NOT NULL GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY pattern ORDER BY n DESC, cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY pattern) AS before FROM n) SELECT pattern, cell, n FROM b WHERE before < 0.8")
def footprints(spark, d):
    p = load(spark, d, "deliveries").select("lat", "lon", "segment").withColumn("cell", spatial.cell_of(F.col("lat"), F.col("lon"), _RES)).where("cell is not null and segment is not null")
    return spatial.footprint(p.groupBy(F.col("segment").alias("pattern"), "cell").agg(F.count(F.lit(1)).alias("n")))


@query(f"WITH {_COV}, zn AS (SELECT cell FROM cl WHERE events >= 20), p AS (SELECT pattern, count(*) AS p, count(zn.cell) AS hit FROM co LEFT JOIN zn USING (cell) GROUP BY 1) SELECT pattern, round(hit / sqrt(p * (SELECT count(*) FROM zn)), 4) AS score FROM p WHERE hit > 0")
def zone_overlaps(spark, d):
    return rounded(spatial.zone_overlap(_cover(spark, d), _cells(spark, d).where("events >= 20").select("cell")))


@query(f"WITH {_COV}, a3 AS (SELECT DISTINCT area AS pattern, '{_RES}:' || q || ':' || r AS cell FROM pt WHERE area IS NOT NULL), s AS (SELECT pattern, count(*) AS size FROM a3 GROUP BY 1), ov AS (SELECT x.pattern AS a, y.pattern AS b, count(*) AS n FROM a3 x JOIN a3 y ON x.cell = y.cell AND x.pattern < y.pattern GROUP BY 1, 2), tc AS (SELECT t.pattern AS a, y.pattern AS b, count(*) AS n FROM (SELECT DISTINCT pattern, nbr AS cell FROM a3 JOIN nb USING (cell)) t JOIN a3 y ON t.cell = y.cell AND t.pattern < y.pattern GROUP BY 1, 2), al AS (SELECT *, 0 AS k FROM ov UNION ALL SELECT *, 1 FROM tc WHERE NOT EXISTS (SELECT 1 FROM ov WHERE ov.a = tc.a AND ov.b = tc.b)), w AS (SELECT a, b, k, least(1, n / least(x.size, y.size)) AS weight FROM al JOIN s x ON a = x.pattern JOIN s y ON b = y.pattern), e AS (SELECT a, b, k, weight, unnest([a, b]) AS en FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY en ORDER BY k, weight DESC, a, b) AS r FROM e) SELECT DISTINCT a, b, CASE WHEN k = 0 THEN 'overlaps' ELSE 'adjacent' END AS relation, round(weight, 4) AS weight FROM r WHERE r <= 3")
def co_located(spark, d):
    return rounded(spatial.co_located(_cover(spark, d, "area"), spatial.neighbour_graph(_cells(spark, d).select("cell"))))


_LQ, _LR = _cell_sql("lat", "lon", 6)
_CTX = f"ly AS (SELECT {_LQ} AS q, {_LR} AS r, count(*) AS k FROM (SELECT DISTINCT point_id, lat, lon FROM layer_points) WHERE {_IN} GROUP BY 1, 2), tg AS (SELECT DISTINCT {_LQ} AS q, {_LR} AS r FROM deliveries WHERE {_IN}), su AS (SELECT '6:' || tg.q || ':' || tg.r AS cell, coalesce(sum(ly.k), 0)::BIGINT AS n FROM tg LEFT JOIN ly ON abs(tg.q - ly.q) <= 1 AND abs(tg.r - ly.r) <= 1 AND abs(tg.q + tg.r - ly.q - ly.r) <= 1 GROUP BY 1)"


def _context(spark, d):
    target = load(spark, d, "deliveries").select(spatial.cell_of(F.col("lat"), F.col("lon"), 6).alias("cell")).where("cell is not null").distinct()
    layer = load(spark, d, "layer_points").select("point_id", "lat", "lon").distinct().select(spatial.cell_of(F.col("lat"), F.col("lon"), 6).alias("cell")).where("cell is not null")
    return spatial.context_sums(target, layer, 1)


@query(f"WITH {_CTX} SELECT cell, n FROM su")
def context_counts(spark, d):
    return _context(spark, d)


@query(f"WITH {_CTX}, e AS (SELECT list_distinct(quantile_cont(n, [0.25, 0.5, 0.75])) AS e FROM su WHERE n > 0) SELECT cell, n, (CASE WHEN n = 0 THEN 0 ELSE 1 + len(list_filter(e, lambda x: n > x)) END)::INT AS band FROM su, e")
def context_bands(spark, d):
    return spatial.context_bands(_context(spark, d))


@query(f"WITH {_CTX} SELECT count(*) AS cells, sum(n)::BIGINT AS total FROM su")
def dealt_totals(spark, d):
    c = _context(spark, d).withColumn("block", spatial.parent(F.col("cell"), 3))
    return spatial.dealt(c, "block", "n", 11).agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("total"))


# --- vectors, anchors and the graph --------------------------------------------------------------

_ANC = "an AS (SELECT vec_id AS anchor, embedding AS c FROM embeddings WHERE vec_id % 40 = 0), sm AS (SELECT vec_id AS id, anchor, list_dot_product(embedding, c) / sqrt(list_dot_product(embedding, embedding) * list_dot_product(c, c)) AS cosine FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings), (SELECT anchor, c::DOUBLE[] AS c FROM an))"


def _anchors(spark, d):
    v = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return v, v.where("id % 40 = 0").select(F.col("id").alias("anchor"), F.col("v").alias("c"))


@query(f"WITH {_ANC}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, anchor) AS rank, max(cosine) OVER (PARTITION BY id) AS best FROM sm) SELECT id, anchor, round(cosine, 4) AS cosine, rank FROM r WHERE rank <= 2 AND cosine >= 0.2 AND cosine >= 0.8 * best")
def anchor_assignment(spark, d):
    v, a = _anchors(spark, d)
    return rounded(anchors.assign(anchors.similarities(v, a), 0.2))


@query(f"WITH {_ANC}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, anchor) AS rank, cosine / max(cosine) OVER (PARTITION BY id) AS ratio FROM sm WHERE cosine > 0) SELECT id, anchor, round(cosine, 4) AS cosine, round(ratio, 4) AS ratio FROM r WHERE rank <= 3")
def anchor_memberships(spark, d):
    v, a = _anchors(spark, d)
    return rounded(anchors.co_memberships(anchors.similarities(v, a)))


_ACT = f"{_ANC}, ac AS (SELECT id, anchor, cosine AS strength FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, anchor) AS rank FROM sm WHERE cosine > 0) WHERE rank <= 3)"


def _activations(spark, d):
    v, a = _anchors(spark, d)
    return anchors.co_memberships(anchors.similarities(v, a)).select("id", "anchor", F.col("cosine").alias("strength"))


@query(f"WITH {_ACT}, w AS (SELECT *, strength * strength / sum(strength) OVER (PARTITION BY id) AS w FROM ac) SELECT x.anchor AS a, y.anchor AS b, round(least(1, sum(x.w * y.w)), 4) AS weight FROM w x JOIN w y ON x.id = y.id AND x.anchor < y.anchor GROUP BY 1, 2")
def anchor_co_occurrence(spark, d):
    return rounded(anchors.co_occurrences(_activations(spark, d)))


@query(f"WITH {_ACT}, m AS (SELECT anchor, sum(strength) AS mass FROM ac GROUP BY 1), s AS (SELECT anchor, mass / sum(mass) OVER () AS share, greatest(0.25, 3.0 / count(*) OVER ()) AS tau FROM m) SELECT anchor, round(share, 4) AS share, round(least(1, tau / share), 4) AS damping FROM s")
def anchor_damping(spark, d):
    return rounded(anchors.damping(_activations(spark, d)))


@query(f"WITH {_ACT} SELECT anchor FROM an WHERE anchor NOT IN (SELECT anchor FROM ac WHERE strength > 0.99)")
def orphan_anchors(spark, d):
    return anchors.orphans(_anchors(spark, d)[1], _activations(spark, d).where("strength > 0.99"))


@query(f"WITH {_ANC}, pr AS (SELECT a.anchor AS a, b.anchor AS b, list_dot_product(a.c::DOUBLE[], b.c::DOUBLE[]) / sqrt(list_dot_product(a.c::DOUBLE[], a.c::DOUBLE[]) * list_dot_product(b.c::DOUBLE[], b.c::DOUBLE[])) AS cosine FROM an a JOIN an b ON a.anchor <> b.anchor), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS r FROM pr WHERE cosine > 0.05) WHERE r <= 3) SELECT t.a, t.b, round(t.cosine, 4) AS cosine FROM t JOIN t u ON t.a = u.b AND t.b = u.a WHERE t.a < t.b")
def related_anchors(spark, d):
    return rounded(anchors.related(_anchors(spark, d)[1], least=0.05))


@query(f"WITH {_ANC}, pr AS (SELECT list_dot_product(a.c::DOUBLE[], b.c::DOUBLE[]) / sqrt(list_dot_product(a.c::DOUBLE[], a.c::DOUBLE[]) * list_dot_product(b.c::DOUBLE[], b.c::DOUBLE[])) AS cosine FROM an a JOIN an b ON a.anchor < b.anchor) SELECT round(CASE WHEN (SELECT count(*) FROM an) < 10 THEN 0.88 ELSE least(0.92, greatest(0.88, quantile_cont(cosine, 0.85))) END, 4) AS tau FROM pr")
def adaptive_threshold(spark, d):
    return rounded(anchors.adaptive_threshold(_anchors(spark, d)[1]))


@query(f"WITH {_ACT}, u AS (SELECT vec_id AS id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), g AS (SELECT anchor, i, sum(strength * x) AS x FROM ac JOIN u USING (id) GROUP BY 1, 2), n AS (SELECT anchor, sqrt(sum(x * x)) AS n FROM g GROUP BY 1) SELECT anchor, round(max(abs(x / n)), 3) AS largest, count(*) AS dim FROM g JOIN n USING (anchor) GROUP BY 1")
def anchor_centroids(spark, d):
    v, _ = _anchors(spark, d)
    c = anchors.centroids(v, _activations(spark, d))
    return c.select("anchor", F.round(F.array_max(F.transform("c", lambda x: F.abs(x))), 3).alias("largest"), F.size("c").cast("bigint").alias("dim"))


_SCHEMA = f"i AS (SELECT * FROM {_INS}), sp AS (SELECT DISTINCT 'HAS_METRIC' AS type, id AS source, 'M:' || dataset_id || ':' || s.metric AS target FROM (SELECT id, dataset_id, unnest(shifts) AS s FROM i) WHERE dataset_id IS NOT NULL UNION ALL SELECT DISTINCT 'HAS_DIMENSION', id, 'D:' || dataset_id || ':' || c.attribute FROM (SELECT id, dataset_id, unnest(conditions) AS c FROM i) UNION ALL SELECT 'IN_BATCH', id, 'B:' || batch_id FROM i WHERE batch_id IS NOT NULL UNION ALL SELECT DISTINCT 'BATCH_OF', 'B:' || batch_id, 'DS:' || dataset_id FROM i WHERE batch_id IS NOT NULL)"


@query(f"WITH {_SCHEMA} SELECT type || ':' || source || '->' || target AS id, source, target, type, 'schema' AS plane, 1.0::DOUBLE AS weight FROM sp")
def schema_plane(spark, d):
    return graph.schema_plane(load(spark, d, "insights"))


@query(f"WITH RECURSIVE {_SCHEMA}, b AS (SELECT source AS x, target AS y FROM sp WHERE type IN ('BATCH_OF', 'IN_BATCH') UNION SELECT target, source FROM sp WHERE type IN ('BATCH_OF', 'IN_BATCH')), w AS (SELECT 'DS:c07a3d915be2' AS node, 0 AS d UNION SELECT b.y, w.d + 1 FROM w JOIN b ON b.x = w.node WHERE w.d < 2) SELECT node, min(d)::INT AS distance FROM w GROUP BY 1")
def breadth_first(spark, d):
    e = graph.schema_plane(load(spark, d, "insights"))
    seeds = spark.createDataFrame([("DS:c07a3d915be2",)], "node string")
    return graph.closure(e, seeds, 2, ["BATCH_OF", "IN_BATCH"])


@query(f"SELECT id, round(0.35 * coalesce(target = 'wait_min', false)::INT + 0.25 * coalesce(len(list_filter(conditions, lambda c: c.attribute = 'segment' AND c.value = 'business')) > 0, false)::INT + 0.15 * coalesce(sign(list_filter(shifts, lambda s: s.metric = 'wait_min')[1].robust_z) = 1, false)::INT + 0.10 * coalesce(weight, 0), 6) AS score FROM {_INS}")
def seed_scores(spark, d):
    return rounded(graph.seed_scores(load(spark, d, "insights"), "wait_min", "segment", "business", 1), 6)


@query(f"WITH RECURSIVE {_SIB}, e AS (SELECT DISTINCT a, b FROM sib UNION SELECT DISTINCT b, a FROM sib), w AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.id) SELECT id, min(root) AS root FROM w GROUP BY 1")
def variant_groups(spark, d):
    s = lattice.siblings(lattice.scopes(load(spark, d, "insights")))
    return connected_components(s.select("a", "b"))


@query()
def transversal_walk(spark, d):
    i = load(spark, d, "insights")
    top = i.where("id is not null").dropDuplicates(["id"]).select("id", F.explode("shifts").alias("s")).select("id", F.concat(F.lit("A-"), "s.metric", F.when(F.col("s.robust_z") >= 0, "+").otherwise("-")).alias("anchor"), F.least(F.lit(1.0), F.abs("s.robust_z") / 5).alias("strength"))
    return pipeline.answer(i, top, "wait_min", "segment", "business", 1, 50)


@query("WITH r AS (SELECT batch_id, dataset_id, count(*) AS n FROM deliveries WHERE batch_id IS NOT NULL GROUP BY 1, 2), x AS (SELECT *, n / sum(n) OVER (PARTITION BY dataset_id) AS share, row_number() OVER (PARTITION BY dataset_id ORDER BY n DESC, batch_id) AS r FROM r) SELECT dataset_id AS pattern, batch_id AS region, n AS \"key\", round(share, 4) AS share FROM x WHERE r <= 5")
def top_places(spark, d):
    g = load(spark, d, "deliveries").where("batch_id is not null").groupBy(F.col("dataset_id").alias("pattern"), F.col("batch_id").alias("region")).agg(F.count(F.lit(1)).alias("key"))
    return rounded(graph.places(g))


@query(f"SELECT id, replace(list_filter(shifts, lambda s: abs(s.robust_z) = {_PRIM})[1].metric, '_', ' ') || ' ' || CASE WHEN list_filter(shifts, lambda s: abs(s.robust_z) = {_PRIM})[1].robust_z >= 0 THEN '↑' ELSE '↓' END || ' in ' || array_to_string(list_transform(conditions, lambda c: replace(c.attribute, '_', ' ') || ' = ' || c.value), ' and ') AS headline FROM {_INS} WHERE {_PRIM} IS NOT NULL")
def headlines(spark, d):
    i = load(spark, d, "insights").where("id is not null").dropDuplicates(["id"]).withColumn("p", lattice.primary_shift(F.col("shifts"))).where("p is not null")
    return i.select("id", lattice.headline(F.col("conditions"), F.col("p.metric"), F.col("p.robust_z")).alias("headline"))


@query(f"SELECT id, 'P-' || left(sha1(dataset_id || '|' || array_to_string(list_sort(list_transform(conditions, lambda c: c.attribute || '==' || c.value)), '&')), 12) AS pattern_id FROM {_INS}")
def pattern_ids(spark, d):
    i = load(spark, d, "insights").where("id is not null").dropDuplicates(["id"])
    return i.select("id", lattice.pattern_id(F.col("dataset_id"), F.col("conditions")).alias("pattern_id"))


# --- single steps that runs are made of -----------------------------------------------------------


@query(f"WITH c AS (SELECT batch_id AS cell, segment AS level, count(*) AS n FROM deliveries WHERE batch_id IS NOT NULL AND segment IS NOT NULL GROUP BY 1, 2), t AS (SELECT cell, sum(n) AS n, max(n) / sum(n) AS top FROM c GROUP BY 1) SELECT round(avg(top), 4) AS purity, count(*) AS cells FROM t WHERE n >= 5")
def role_purity(spark, d):
    return rounded(spatial.purity(spatial.level_shares(load(spark, d, "deliveries"), F.col("batch_id"), "segment")))


@query("WITH e AS (SELECT segment AS pattern, area AS region FROM deliveries WHERE area IS NOT NULL), g AS (SELECT pattern, region, count(*) AS x FROM e WHERE pattern IS NOT NULL GROUP BY 1, 2), t AS (SELECT g.pattern, g.region, x, np * nr / (SELECT count(*) FROM e) AS expected, nr / (SELECT count(*) FROM e) AS share FROM g JOIN (SELECT region, count(*) AS nr FROM e GROUP BY 1) USING (region) JOIN (SELECT pattern, count(*) AS np FROM e GROUP BY 1) USING (pattern)) SELECT pattern, region, x, round(expected, 4) AS expected, round(x / expected, 4) AS lift FROM t WHERE x / expected >= 1.02 AND x >= 30")
def region_lifts(spark, d):
    e = load(spark, d, "deliveries").where("area is not null").select(F.col("segment").alias("pattern"), F.col("area").alias("region"))
    return rounded(spatial.region_lift(e, 1.02, 1.0).where("x >= 30").select("pattern", "region", "x", "expected", "lift"))


@query("WITH t AS (SELECT quantile_cont(epoch(ts), 0.01) AS a, quantile_cont(epoch(ts), 0.99) AS b, count(*) AS n FROM (SELECT date_trunc('second', ts) AS ts FROM events WHERE ts IS NOT NULL)), u AS (SELECT unnest([{'g': 'day', 'd': 1.0}, {'g': 'week', 'd': 7.0}, {'g': 'month', 'd': 30.4375}, {'g': 'quarter', 'd': 91.3125}]) AS u) SELECT u.g AS grid, greatest(1, ceil((b - a) / 86400 / u.d))::BIGINT AS bins, round(n / greatest(1, ceil((b - a) / 86400 / u.d)), 4) AS rows_per_bin FROM t, u")
def grid_choices(spark, d):
    return rounded(timeplane.auto_grid(load(spark, d, "events"), "ts"))


@query("SELECT DISTINCT p.period, round(greatest(0, date_diff('day', greatest(p.period, DATE '2024-02-10'), least(p.period + INTERVAL 7 DAY, DATE '2024-04-01'))) / 51, 4) AS cover FROM (SELECT DISTINCT date_trunc('week', ts)::DATE AS period FROM events WHERE ts IS NOT NULL) p")
def interval_covers(spark, d):
    p = load(spark, d, "events").where("ts is not null").select(F.to_date(F.date_trunc("week", "ts")).alias("period")).distinct()
    lo, hi = (F.lit(x).cast("date") for x in ("2024-02-10", "2024-04-01"))
    return rounded(p.select("period", timeplane.interval_cover(F.col("period"), F.date_add("period", 7), lo, hi).alias("cover")))


@query(f"SELECT id, len(list_filter(shifts, lambda s: s.metric = target OR abs(s.robust_z) >= 1 AND NOT isnan(s.robust_z))) AS n FROM {_INS} WHERE shifts IS NOT NULL AND target IS NOT NULL AND len(list_filter(shifts, lambda s: s.robust_z IS NULL OR isnan(s.robust_z))) = 0")
def material_shifts(spark, d):
    i = load(spark, d, "insights").where("id is not null and shifts is not null and target is not null and not exists(shifts, s -> s.robust_z is null or isnan(s.robust_z))").dropDuplicates(["id"])
    return i.select("id", F.size(lattice.phenomenon_shifts(F.col("shifts"), F.col("target"))).cast("bigint").alias("n"))


@query("SELECT dataset_id, sha256('{\"filename\":\"' || filename || '\",\"grid\":\"' || grid || '\"}') AS digest FROM datasets WHERE filename IS NOT NULL AND grid IS NOT NULL")
def record_digests(spark, d):
    t = load(spark, d, "datasets").where("filename is not null and grid is not null")
    return t.select("dataset_id", lattice.record_digest(t, ["grid", "filename"]).alias("digest"))


@query(f"SELECT rank, id, rank || '. ' || target AS line FROM (SELECT id, target, row_number() OVER (ORDER BY weight DESC, id) AS rank FROM {_INS} WHERE weight IS NOT NULL AND target IS NOT NULL) WHERE rank <= 25")
def report_lines(spark, d):
    i = load(spark, d, "insights").where("id is not null and weight is not null and target is not null").dropDuplicates(["id"])
    return lattice.ranked_lines(i.select("id", "weight", F.col("target").alias("line")), 25)


@query(f"SELECT dataset_id AS anchor, s.metric AS component, round(sum(weight * s.robust_z), 4) + 0.0 AS \"value\" FROM (SELECT dataset_id, weight, unnest(shifts) AS s FROM {_INS}) WHERE dataset_id IS NOT NULL AND weight IS NOT NULL AND s.robust_z IS NOT NULL AND NOT isnan(s.robust_z) GROUP BY 1, 2")
def signatures(spark, d):
    i = load(spark, d, "insights").where("id is not null and dataset_id is not null and weight is not null").dropDuplicates(["id"])
    m = i.select(F.col("dataset_id").alias("anchor"), F.col("weight").alias("strength"), F.explode("shifts").alias("s")).select("anchor", "strength", F.col("s.metric").alias("component"), F.col("s.robust_z").alias("z")).where("z is not null and not isnan(z)")
    return rounded(anchors.signature(m).select("anchor", "component", "value"))


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT vec_id, e[1:16] AS a, e[17:32] AS b, e[33:] AS c FROM v WHERE len(e) > 32), n AS (SELECT vec_id, list_concat(list_transform(a, lambda x: 0.45 * x / sqrt(list_dot_product(a, a))), list_concat(list_transform(b, lambda x: 0.55 * x / sqrt(list_dot_product(b, b))), list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))))) AS w FROM u) SELECT vec_id, round(w[1] / sqrt(list_dot_product(w, w)), 4) + 0.0 AS first, round(w[len(w)] / sqrt(list_dot_product(w, w)), 4) + 0.0 AS last FROM n")
def composites(spark, d):
    e = load(spark, d, "embeddings").where("size(embedding) > 32")
    blocks = [F.slice("embedding", 1, 16), F.slice("embedding", 17, 16), F.slice("embedding", F.lit(33), F.size("embedding") - 32)]
    return rounded(e.select("vec_id", anchors.compose(*blocks).alias("w")).select("vec_id", F.get("w", F.lit(0)).alias("first"), F.element_at("w", -1).alias("last")))


@query("SELECT discount, round((1 - r) / (1 + r), 6) AS factor FROM (SELECT DISTINCT l_discount AS discount, least(greatest(l_discount * 12 - 0.2, 0), 0.99) AS r FROM lineitem WHERE l_discount IS NOT NULL)")
def effective_n_factors(spark, d):
    t = load(spark, d, "lineitem").where("l_discount is not null").select(F.col("l_discount").alias("discount")).distinct()
    return t.select("discount", F.round(S.effective_n_factor(F.col("discount") * 12 - 0.2), 6).alias("factor"))


@query(f"WITH {_CELLS} SELECT '5:' || {_PQ} || ':' || {_PR} AS tile, '[' || array_to_string(list(cell ORDER BY cell), ', ') || ']' AS cells, '[' || array_to_string(list(events ORDER BY cell), ', ') || ']' AS events FROM cl GROUP BY 1")
def packed_cells(spark, d):
    t = spatial.cell_table(load(spark, d, "deliveries").select("lat", "lon", "basket"), "lat", "lon", _RES, ["basket"])
    p = exports.packed(t.withColumn("tile", spatial.parent(F.col("cell"), 5)), "tile", ["events"])
    text = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]"))
    return p.select("tile", text("cell").alias("cells"), text("events").alias("events"))
