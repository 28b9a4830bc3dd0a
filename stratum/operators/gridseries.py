"""Irregular readings onto a regular calendar grid, gaps filled by low-rank factorisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.runtime import saved

UNITS = {"day": "DAY", "week": "WEEK", "month": "MONTH", "quarter": "QUARTER"}
RANK = 3
ROUNDS = 6


def period_start(local: F.Column, grid: F.Column) -> F.Column:
    """First local day of the period that holds a local time; null for an unknown grid."""
    out = F.lit(None).cast("date")
    for name, unit in UNITS.items():
        out = F.when(grid == name, F.trunc(local, unit) if unit != "DAY" else F.to_date(local)).otherwise(out)
    return out


def next_period(day: F.Column, grid: F.Column) -> F.Column:
    return F.when(grid == "day", F.date_add(day, 1)).when(grid == "week", F.date_add(day, 7)).when(grid == "month", F.add_months(day, 1)).otherwise(F.add_months(day, 3))


def observed_cells(readings: DataFrame, datasets: DataFrame) -> DataFrame:
    """(source_id, grid, period, value, n): mean of the usable readings of each occupied period.

    Usable: read_at is not null and value is a finite number. Exact repeats count once.
    The calendar is that of the dataset's tz (null: UTC). A reading whose dataset is unknown or
    whose grid is not one of day, week, month, quarter has no period and is left out.
    """
    kept = readings.select("source_id", "dataset_id", "read_at", F.col("value").cast("double").alias("value"))
    kept = kept.where("source_id is not null and read_at is not null and value is not null and not isnan(value) and abs(value) < double('infinity')")
    calendar = datasets.select("dataset_id", F.lower("grid").alias("grid"), F.coalesce("tz", F.lit("UTC")).alias("tz")).where(F.col("grid").isin(*UNITS)).dropDuplicates(["dataset_id"])
    timed = kept.join(calendar, "dataset_id")
    # wall times without a zone, so that the session's own zone has no part in it
    utc = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, unix_micros(read_at) / 1000000BD)") if dict(readings.dtypes)["read_at"] == "timestamp" else F.col("read_at")
    local = F.convert_timezone(F.lit("UTC"), F.col("tz"), utc)
    timed = timed.withColumn("period", period_start(local, F.col("grid")))
    # sums of two levels: the first adds up exact repeats, so that a burst in one source is combined map-side
    return timed.groupBy("source_id", "grid", "period", "read_at", "value").agg(F.lit(1).alias("one")).groupBy("source_id", "grid", "period").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))


def regular_series(readings: DataFrame, datasets: DataFrame, rank: int = RANK, rounds: int = ROUNDS) -> DataFrame:
    """A row for every period of each source between its first and last usable reading.

    Columns: source_id, grid, period (date), value, n (readings in it), status:

    * ``observed`` - the mean of the period's readings, exact;
    * ``filled`` - no reading; value from the factorisation of the source-by-period matrix;
    * ``unsupported`` - no reading, and the source has fewer than ``rank`` + 1 observed periods or
      no other source has a reading in the period; value is null.

    The matrix of a grid has a row per source (standardised by its own mean and deviation) and a
    column per period; alternating least squares (blocked, shuffling factors rather than the matrix)
    fits ``rank`` factors to the observed cells. A source with no usable reading gives no row.
    """
    cells = saved(observed_cells(readings, datasets), "cells")
    source = cells.groupBy("source_id", "grid").agg(F.min("period").alias("first"), F.max("period").alias("last"), F.count(F.lit(1)).alias("n_cells"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    step = F.expr("CASE grid WHEN 'day' THEN sequence(first, last, interval 1 day) WHEN 'week' THEN sequence(first, last, interval 7 days) WHEN 'month' THEN sequence(first, last, interval 1 month) ELSE sequence(first, last, interval 3 months) END")
    grid = source.select("source_id", "grid", F.explode(step).alias("period"))
    gaps = grid.join(cells.select("source_id", "grid", "period"), ["source_id", "grid", "period"], "left_anti")
    seen = cells.groupBy("grid", "period").agg(F.count(F.lit(1)).alias("n_sources"))

    scaled = cells.join(source.select("source_id", "grid", "mean", "sd"), ["source_id", "grid"]).withColumn("z", F.when(F.col("sd") > 0, (F.col("value") - F.col("mean")) / F.col("sd")).otherwise(F.lit(0.0)))
    users, items = _codes(cells.select("source_id").distinct(), ["source_id"], "u"), _codes(seen.select("grid", "period"), ["grid", "period"], "i")
    users, items = saved(users, "users"), saved(items, "items")
    train = scaled.join(users, "source_id").join(items, ["grid", "period"]).select("u", "i", F.col("z").cast("float").alias("z"))
    observed = cells.select("source_id", "grid", "period", "value", "n", F.lit("observed").alias("status"))
    if train.isEmpty():
        return observed
    model = _fit(train, rank, rounds)
    uf = model.userFactors.select(F.col("id").alias("u"), F.col("features").alias("fu")).join(users, "u").select("source_id", "fu")
    pf = model.itemFactors.select(F.col("id").alias("i"), F.col("features").alias("fi")).join(items, "i").select("grid", "period", "fi")
    wide = gaps.join(source, ["source_id", "grid"]).join(seen, ["grid", "period"], "left").join(uf, "source_id", "left").join(pf, ["grid", "period"], "left")
    fit = F.aggregate(F.zip_with("fu", "fi", lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda a, x: a + x)
    ok = (F.col("n_cells") > rank) & (F.coalesce("n_sources", F.lit(0)) > 0) & F.col("fu").isNotNull() & F.col("fi").isNotNull()
    filled = wide.select("source_id", "grid", "period", F.when(ok, F.col("mean") + F.col("sd") * fit).alias("value"), F.lit(0).cast("bigint").alias("n"), F.when(ok, "filled").otherwise("unsupported").alias("status"))
    return observed.unionByName(filled)


def _codes(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Dense int codes: rows of each partition are numbered from the partition's offset."""
    part = saved(df.select(*keys, F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")), "codes")
    sizes = part.groupBy("p").count().orderBy("p").collect()  # one row for each partition
    offset, total = {}, 0
    for r in sizes:
        offset[r["p"]] = total
        total += r["count"]
    if total >= 2**31:
        raise ValueError("more than 2^31 rows or columns in one matrix")
    if not offset:
        return part.select(*keys, F.lit(0).alias(name))
    at = part.sparkSession.createDataFrame(list(offset.items()), "p int, start bigint")  # a row for each partition
    return part.join(F.broadcast(at), "p").select(*keys, (F.col("start") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).cast("int").alias(name))


def _fit(train: DataFrame, rank: int, rounds: int):
    from pyspark.ml.recommendation import ALS

    blocks = max(2, min(200, train.sparkSession.sparkContext.defaultParallelism))
    return ALS(rank=rank, maxIter=rounds, regParam=0.1, numUserBlocks=blocks, numItemBlocks=blocks, userCol="u", itemCol="i", ratingCol="z", seed=7, checkpointInterval=3).fit(train)


def missing_periods(readings: DataFrame, datasets: DataFrame) -> DataFrame:
    """(source_id, period as text): the periods of :func:`regular_series` without a usable reading."""
    series = regular_series(readings, datasets)
    return series.where("status <> 'observed'").select("source_id", F.date_format("period", "yyyy-MM-dd").alias("period"))
