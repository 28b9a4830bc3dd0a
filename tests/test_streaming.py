from datetime import datetime, timedelta

from stratum.sources.store import Store
from stratum.streaming import incremental


def landed(spark, path):
    t0 = datetime(2024, 1, 1)
    for k in range(3):
        rows = [(t0 + timedelta(days=k, hours=h), "x" if h % 2 else "y", float(h)) for h in range(6)]
        spark.createDataFrame(rows, "ts timestamp, k string, v double").coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path).schema


def test_windows_levels_and_store(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = landed(spark, path)
    q = incremental.windowed(incremental.replay(spark, path, schema), "ts", "k", "v").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from w").first()[0] == 18 and spark.table("w").count() == 6

    q = incremental.forward_level(incremental.replay(spark, path, schema, 10), "k", "ts", "v").writeStream.outputMode("update").format("memory").queryName("lv").start()
    q.processAllAvailable()
    q.stop()
    assert {r["k"]: r["n"] for r in spark.table("lv").collect()} == {"x": 9, "y": 9}

    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):  # the second run finds nothing new
        q = incremental.into_store(incremental.replay(spark, path, schema), store, "t", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
    assert store.read("t").count() == 18
