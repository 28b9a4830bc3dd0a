"""A versioned store of tables: batches are appended or rewritten, a manifest names what counts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Tables as folders of versions under a root that all executors share.

    A commit writes new folders first and the manifest last, by a rename, so that a crash leaves the
    former state; folders that no manifest names are ignored and can be swept. Batches are named, and
    a batch that is there already isn't written again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def manifest(self) -> dict:
        """{version, tables: {name: {batch: folder}}} of the last commit."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        versions = sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))
        if not versions:
            return {"version": 0, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.root}/manifest-{versions[-1]}.json", wholetext=True).first()[0])

    def _publish(self, m: dict) -> None:
        tmp, final = self._path(f"{self.root}/.pending-{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest-{m['version']}.json")
        out = self._fs.create(tmp, False)
        out.write(bytearray(json.dumps(m, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(tmp, final):
            self._fs.delete(tmp, True)
            raise RuntimeError("another commit came first")

    def commit(self, batch: str, tables: dict[str, DataFrame]) -> bool:
        """Add a batch's tables; False if the batch is there already."""
        m = self.manifest()
        if any(batch in t for t in m["tables"].values()):
            return False
        for name, df in tables.items():
            folder = f"{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{folder}")
            m["tables"].setdefault(name, {})[batch] = folder
        m["version"] += 1
        self._publish(m)
        return True

    def drop(self, batches: set[str]) -> int:
        """Leave batches out of the next version; returns how many there were."""
        m = self.manifest()
        gone = {b for t in m["tables"].values() for b in t} & batches
        m["tables"] = {n: {b: f for b, f in t.items() if b not in batches} for n, t in m["tables"].items()}
        m["version"] += 1
        self._publish(m)
        return len(gone)

    def read(self, name: str) -> DataFrame | None:
        """All batches of a table, with the batch's name; None if there is none."""
        parts = self.manifest()["tables"].get(name, {})
        dfs = [self.spark.read.parquet(f"{self.root}/{f}").withColumn("_batch", F.lit(b)) for b, f in sorted(parts.items())]
        if not dfs:
            return None
        out = dfs[0]
        for d in dfs[1:]:
            out = out.unionByName(d, allowMissingColumns=True)
        return out

    def sweep(self) -> int:
        """Delete folders that the last manifest doesn't name; returns how many."""
        m = self.manifest()
        live, n = {f for t in m["tables"].values() for f in t.values()}, 0
        for t in self._fs.listStatus(self._path(self.root)):
            if t.isDirectory():
                for s in self._fs.listStatus(t.getPath()):
                    if f"{t.getPath().getName()}/{s.getPath().getName()}" not in live:
                        self._fs.delete(s.getPath(), True)
                        n += 1
        return n
