"""Files in: sniffed text tables, Parquet, digests, row filters, categories, bands, points and times."""

from __future__ import annotations

import hashlib
import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DELIMITERS = [",", ";", "\t", "|"]
TIME_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy", "MM/dd/yyyy HH:mm", "MM/dd/yyyy", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "yyyyMMdd"]
LAT_TOKENS, LON_TOKENS = {"lat", "latitude", "y"}, {"lon", "lng", "long", "longitude", "x"}


class IngestionError(ValueError):
    """A table or option that can't be read; the message says why."""


def sniff_delimiter(line: str) -> str:
    """The delimiter that occurs most in a header line outside quotes; a comma if none does."""
    bare = re.sub(r'"[^"]*"', "", line.lstrip("\ufeff"))
    best = max(DELIMITERS, key=lambda d: (bare.count(d), -DELIMITERS.index(d)))
    return best if bare.count(best) else ","


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV, TXT, TSV, JSON lines, ORC or Parquet by extension; text tables with a header and one type a column."""
    low = path.lower().rstrip("/")
    if low.endswith((".csv", ".txt", ".tsv", ".csv.gz")):
        head = spark.read.text(path).limit(1).collect()
        if not head:
            raise IngestionError(f"{path} is empty")
        sep = "\t" if low.endswith(".tsv") else sniff_delimiter(head[0][0])
        df = spark.read.options(sep=sep, header=True, inferSchema=True, quote='"', escape='"', multiLine=False).csv(path)
        return df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])
    if low.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    return spark.read.orc(path) if low.endswith(".orc") else spark.read.parquet(path)


def content_digest(spark: SparkSession, path: str) -> str:
    """One digest of all files under a path: of the sorted digests of each, taken by the executors."""
    one = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.sha2("content", 256).alias("d"))
    return hashlib.sha256("".join(sorted(r["d"] for r in one.toLocalIterator())).encode()).hexdigest()


def dataset_fingerprint(digest: str, options: dict) -> str:
    """Twelve hex digits of the content's digest and the canonical options; options left out don't count."""
    canon = json.dumps({k: v for k, v in options.items() if v not in (None, "", [], {})}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(f"{digest}|{canon}".encode()).hexdigest()[:12]


def select_present(columns: list[str], df: DataFrame, strict: bool = True) -> list[str]:
    missing = [c for c in columns if c not in df.columns]
    if missing and strict:
        raise IngestionError(f"no such column: {', '.join(missing)}")
    return [c for c in columns if c in df.columns]


def parse_where(spec: str | None) -> tuple[str, str] | None:
    if not spec:
        return None
    name, eq, value = spec.partition("=")
    if not eq or not name.strip() or not value.strip():
        raise IngestionError("where must be column=value")
    return name.strip(), value.strip()


def filter_rows(df: DataFrame, where: str | None) -> DataFrame:
    """Rows with column = value as text; the column, which must have 2 to 40 values, is then dropped."""
    spec = parse_where(where)
    if spec is None:
        return df
    name, value = spec
    select_present([name], df)
    n = df.select(F.col(name).cast("string")).where(F.col(name).isNotNull()).distinct().limit(41).count()
    if not 2 <= n <= 40:
        raise IngestionError(f"{name} has {'over 40' if n > 40 else n} values")
    return df.where(F.col(name).cast("string") == value).drop(name)


def value_counts(df: DataFrame, column: str, min_rows: int) -> DataFrame:
    """(value, n, state): ``ok`` from ``min_rows`` rows on, else ``sparse``."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.when(F.col("n") >= min_rows, "ok").otherwise("sparse"))


def apply_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers that are codes become text: 1.0 as 1, missing as ``missing``."""
    for c in select_present(columns, df):
        kind = dict(df.dtypes)[c]
        text = F.when(F.isnan(F.col(c)) | F.col(c).isNull(), None).when(F.col(c) == F.floor(c), F.col(c).cast("bigint").cast("string")).otherwise(F.col(c).cast("string")) if kind in ("double", "float") else F.col(c).cast("string")
        df = df.withColumn(c, F.coalesce(text, F.lit("missing")))
    return df


def band_edges(df: DataFrame, column: str, k: int) -> list[float]:
    """Inner edges of ``k`` quantile bands, exact, repeats dropped."""
    row = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).agg(F.percentile(F.col(column).cast("double"), F.array(*[F.lit(i / k) for i in range(k + 1)]))).first()[0]
    out: list[float] = []
    for e in row or []:
        if not out or e != out[-1]:
            out.append(e)
    return out


def band(c: Column, edges: list[float]) -> Column:
    """q1, q2...: right-closed bands, the lowest edge in the first; null and NaN as ``missing``."""
    if len(edges) < 2:
        return F.when(c.isNull() | F.isnan(c.cast("double")), "missing").otherwise("q1")
    above = sum((F.when(c > e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return F.when(c.isNull() | F.isnan(c.cast("double")), "missing").otherwise(F.concat(F.lit("q"), (above + 1).cast("string")))


def apply_bins(df: DataFrame, bins: dict[str, int]) -> DataFrame:
    """``<column>_band`` for each column, which is dropped."""
    for c, k in bins.items():
        select_present([c], df)
        df = df.withColumn(f"{c}_band", band(F.col(c), band_edges(df, c, k))).drop(c)
    return df


def parse_points(text: Column) -> tuple[Column, Column]:
    """(lat, lon) of GeoJSON or WKT point text; null where it is neither or out of range."""
    num = r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
    pat = rf"(?i)(?:POINT\s*\(\s*|\"coordinates\"\s*:\s*\[\s*){num}[\s,]+{num}"
    lon, lat = (F.nullif(F.regexp_extract(text, pat, k), F.lit("")).try_cast("double") for k in (1, 2))
    ok = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(ok, lat), F.when(ok, lon)


def locate_points(df: DataFrame, locator: str = "auto") -> tuple[Column, Column]:
    """(lat, lon) columns: a named pair ``lat,lon`` or ``lon,lat``, a text column of points, or the first found."""
    tokens = lambda c: set(re.split(r"[^a-z]+", c.lower()))
    if locator != "auto":
        names = [x.strip() for x in locator.split(",")]
        select_present(names, df)
        if len(names) == 1:
            return parse_points(F.col(names[0]))
        if tokens(names[0]) & LON_TOKENS and tokens(names[1]) & LAT_TOKENS:
            names.reverse()
        return F.col(names[0]).cast("double"), F.col(names[1]).cast("double")
    lat, lon = (next((c for c in df.columns if tokens(c) & t), None) for t in (LAT_TOKENS, LON_TOKENS))
    if lat and lon:
        return F.col(lat).cast("double"), F.col(lon).cast("double")
    for c, kind in df.dtypes:
        if kind == "string" and not df.select(parse_points(F.col(c))[0].alias("lat")).where("lat is not null").limit(1).isEmpty():
            return parse_points(F.col(c))
    raise IngestionError("no point columns")


def winning_format(df: DataFrame, column: str) -> str | None:
    """The one time format that reads most texts of a column, in one pass over all of them."""
    row = df.agg(*[F.count(F.try_to_timestamp(F.col(column), F.lit(f))).alias(f"f{k}") for k, f in enumerate(TIME_FORMATS)]).first()
    best = max(range(len(TIME_FORMATS)), key=lambda k: (row[k], -k))
    return TIME_FORMATS[best] if row[best] else None


def read_times(df: DataFrame, column: str, tz: str = "UTC", out: str = "at") -> DataFrame:
    """Adds the column's instants (UTC), read with its winning format in ``tz``."""
    if dict(df.dtypes)[column] != "string":
        return df.withColumn(out, F.col(column).cast("timestamp"))
    fmt = winning_format(df, column)
    if fmt is None:
        raise IngestionError(f"{column} holds no times")
    return df.withColumn(out, F.to_utc_timestamp(F.try_to_timestamp(F.col(column), F.lit(fmt)), tz))


def with_row_id(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Adds row_id: the position in an order, or for files the order of the files' rows."""
    if order:
        return df.withColumn("row_id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)) - 1)
    rows = df.rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    return df.sparkSession.createDataFrame(rows, df.schema.add("row_id", "bigint"))


def parse_metadata(text: str) -> dict[str, str]:
    """``Key: value`` blocks; an indented or bare line continues the value before it."""
    out: dict[str, str] = {}
    key = None
    for line in text.splitlines():
        m = re.match(r"([A-Za-z][\w ]{0,40}):\s*(.*)$", line)
        if m and not line.startswith((" ", "\t")):
            key = m[1].strip().lower().replace(" ", "_")
            out[key] = m[2].strip()
        elif key and line.strip():
            out[key] = f"{out[key]} {line.strip()}".strip()
    return out


def retail_table(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """A made-up order table with planted effects: margin +5 for EU laptops, +4 more online, discount +9 in US phones."""
    pick = lambda salt, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(F.xxhash64("order_id", F.lit(seed), F.lit(salt)), F.lit(len(xs))) + 1).cast("int"))
    u = lambda salt: (F.pmod(F.xxhash64("order_id", F.lit(seed), F.lit(salt)), F.lit(1_000_003)) + 0.5) / 1_000_003.0
    g = lambda salt: F.sqrt(-2 * F.log(u(salt))) * F.cos(2 * math.pi * u(salt + 1))
    t = spark.range(n).withColumnRenamed("id", "order_id").withColumn("region", pick(1, ["EU", "US", "APAC", "LATAM"])).withColumn("category", pick(2, ["laptops", "phones", "tablets", "accessories"])).withColumn("channel", pick(3, ["online", "retail", "partner"])).withColumn("payment", pick(4, ["card", "cash", "invoice"]))
    eu = (F.col("region") == "EU") & (F.col("category") == "laptops")
    margin = 20 + 2 * g(10) + F.when(eu, 5).otherwise(0) + F.when(eu & (F.col("channel") == "online"), 4).otherwise(0)
    discount = 10 + 3 * g(20) + F.when((F.col("region") == "US") & (F.col("category") == "phones"), 9).otherwise(0)
    return t.withColumn("margin", margin).withColumn("discount", discount).withColumn("delivery_days", 4 + g(30))
