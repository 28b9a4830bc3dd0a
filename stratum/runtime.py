"""Session-level helpers: table access, shared storage and size-checked broadcasts."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def process_cache() -> dict:
    """A dict of this worker process, kept from one task to the next."""
    return sys.__dict__.setdefault("_stratum_cache", {})


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, ``<sf_dir>/<name>.parquet`` (a file or a folder)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cores: int = 8, partitions: int = 8, app: str = "stratum") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller's session is used."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else one of our own (local runs)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="stratum-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def saved(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The table outlives a lost executor. It is removed by :func:`forget`, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratum-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stratum_path = path  # type: ignore[attr-defined]
    return out


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget(df: DataFrame) -> None:
    """Remove a :func:`saved` table that nothing reads any more."""
    path = getattr(df, "_stratum_path", None)
    for k, (spark, at) in enumerate(_written):
        if at == path:
            _remove(spark, at)
            del _written[k]
            return


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone
            pass


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` if it has at most ``max_rows`` rows, else leave the join to Spark.

    ``df`` should be cheap to count, such as a saved table.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(spark: SparkSession, n_bytes: float, per_task: float = 48e6) -> int:
    """Partitions for ``n_bytes`` of data, no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n_bytes / per_task) + 1)


def widened(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its plan has fewer partitions, as a small file's has; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
