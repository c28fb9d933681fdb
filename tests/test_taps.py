import random

import pytest
from pyspark.sql import functions as F

from chromaframe.streaming import taps

ROWS = [(1, 1, 0.0, 2), (2, 1, 0.3, 2), (3, 1, 0.5, 2), (4, 1, 0.8, 2), (5, 1, 2.0, None), (6, 1, 2.1, None), (7, 2, 0.0, 1), (8, 2, 0.2, 3)]
EXPECTED = {1: "inspect", 2: "focus", 3: "inspect", 4: "focus", 5: "inspect", 6: "reset", 7: "inspect", 8: "inspect"}


def frame(spark):
    return spark.createDataFrame(ROWS, "event_id long, user_id long, s double, band int").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long"))).drop("s")


def test_batch(spark):
    assert {r.event_id: r.action for r in taps.double_taps(frame(spark)).collect()} == EXPECTED


def test_batch_of_one_busy_user(spark):
    r = random.Random(6)
    data, at = [], 0
    for i in range(2000):
        at += r.choice([0, 100_000, 450_000, 450_001, 900_000])
        data.append((i, r.choice([1, 1, 1, 2]), at, r.choice([None, 1, 1])))
    frame = spark.createDataFrame(data, "event_id long, user_id long, us long, band int").withColumn("ts", F.timestamp_micros("us"))
    want, last = {}, {}
    for i, user, us, band in data:
        want[i], last[user] = taps._step(last.get(user), "" if band is None else str(band), us / 1e6, taps.DOUBLE_S)
    got = taps.double_taps(frame.repartition(3))
    assert {x.event_id: x.action for x in got.collect()} == want and set(want.values()) == {"inspect", "focus", "reset"}
    assert "InPandas" not in got._jdf.queryExecution().toString()  # a user's taps are not held in a Python worker


def test_stream_equals_batch(spark, tmp_path):
    for i, part in enumerate(([1, 7], [2, 3, 8], [4, 5], [6])):
        frame(spark).where(F.col("event_id").isin(part)).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(frame(spark).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = taps.double_tap_stream(stream).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
    q.awaitTermination()
    assert {r.event_id: r.action for r in spark.read.parquet(str(tmp_path / "out")).collect()} == EXPECTED


def test_debounce(spark):
    assert {r.event_id for r in taps.debounced(frame(spark), 180).collect()} == {1, 2, 3, 4, 6, 7, 8}


@pytest.mark.parametrize("gap", [180, 1000])
def test_debounced_stream_equals_batch(spark, tmp_path, gap):
    """Events in disorder over several micro-batches, with ties, late ones and one that moves the time on at the end."""
    r = random.Random(gap)
    data = [(i, r.choice([1, 1, 1, 2, 3]), r.randrange(0, 60_000_000, 20_000)) for i in range(300)]
    data += [(900, 1, 30_000_000), (901, 1, 30_000_000), (902, 4, 70_000_000)]
    came = sorted(data, key=lambda e: e[2] + r.randrange(4_000_000))
    parts = [came[k : k + 60] for k in range(0, len(came), 60)] + [[(950, 5, 200_000_000)], [(951, 5, 1_000_000), (None, 1, 1), (952, None, 2)]]
    schema = "event_id long, user_id long, us long"
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros("us")).drop("us").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = taps.debounced_stream(stream, gap).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
        q.awaitTermination()
    finally:
        spark.conf.unset(provider)
    whole = spark.createDataFrame([e for p in parts[:-1] for e in p], schema).withColumn("ts", F.timestamp_micros("us"))
    want = {(x.user_id, x.event_id, x.ts) for x in taps.debounced(whole, gap).collect() if x.event_id != 950}
    assert {tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect()} == want and len(want) > 20
