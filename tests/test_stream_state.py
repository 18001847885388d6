"""Stream state that falls: timers at event time drop what no event can tell from nothing."""

import json

import pytest
from pyspark.sql import functions as F

from evidentia.streaming import incremental


@pytest.fixture(autouse=True)
def state_store(spark):
    key, value = incremental.STATE_STORE
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    yield
    spark.conf.set(key, before)


def run(spark, tmp_path, op, batches, kind):
    """op over files that come one a batch: the rows, and the rows of state after each batch, timers left out."""
    folder, name = str(tmp_path / "in"), f"out_{kind}"
    schema = "k string, ts double"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        query = op(stream).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / "log")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        yield i, [json.loads(p.json) for p in query.recentProgress]
        query.stop()


def keys_held(progress):
    return progress[-1]["stateOperators"][0]["customMetrics"], progress[-1]["stateOperators"][0]["numRowsTotal"]


def plain_gaps(batches, gap):
    free, out = {}, []
    for rows in batches:
        for k, t in sorted(rows, key=lambda r: r[1]):
            at = max(t, free.get(k, float("-inf")))
            free[k] = at + gap
            out.append((k, t, at))
    return sorted(out)


def test_rate_limits_hold_and_their_state_falls(spark, tmp_path):
    batches = [
        [(f"d{i}", 1000.0 + i / 100) for i in range(40)] + [("hot", 1000.0)] * 5,
        [("hot", 1001.0), ("d1", 1000.5)],
        [("hot", 1500.0)],  # the watermark passes all of the first batch
        [("hot", 1500.5), ("d1", 1500.5)],
        [("late", 1000.0), ("hot", 3000.0)],
    ]
    held = []
    for _, progress in run(spark, tmp_path, lambda s: incremental.rate_limited(s, key="k", gap=2.0, delay="60 seconds"), batches, "gaps"):
        held.append(max(keys_held([p])[1] for p in progress[-1:]))
    got = sorted((r.k, r.ts, r.allowed_at) for r in spark.read.parquet(str(tmp_path / "out_gaps")).collect())
    want = plain_gaps([[r for r in b if r[0] != "late"] for b in batches], 2.0)
    assert got == want
    # 41 keys at first; after the watermark has passed them only those of the last minute are kept
    assert held[0] >= 41 and held[2] <= held[0] / 5 and held[-1] <= held[0] / 5


def test_entries_expire_in_the_stream(spark, tmp_path):
    batches = [
        [("a", 0.0), ("a", 5.0), ("b", 1.0), ("a", 12.0)] + [(f"x{i}", 2.0) for i in range(30)],
        [("a", 20.0), ("b", 30.0)],
        [("b", 35.0), ("a", 500.0)],
        [("b", 501.0), ("a", 505.0)],
    ]
    batches = [[(k, 1000 + t) for k, t in b] for b in batches]
    held = []
    for _, progress in run(spark, tmp_path, lambda s: incremental.live_entries(s, key="k", ttl=10.0, delay="30 seconds"), batches, "entries"):
        held.append(keys_held(progress)[1])
    got = sorted((r.k, r.ts - 1000, r.hit) for r in spark.read.parquet(str(tmp_path / "out_entries")).where("k in ('a', 'b')").collect())
    assert got == [("a", 0.0, False), ("a", 5.0, True), ("a", 12.0, False), ("a", 20.0, True), ("a", 500.0, False), ("a", 505.0, True), ("b", 1.0, False), ("b", 30.0, False), ("b", 35.0, True), ("b", 501.0, False)]
    assert held[0] >= 32 and held[-1] <= held[0] / 4


def test_rows_without_a_time_and_extra_columns(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("a", 1.0, 7), ("a", None, 7), (None, 2.0, 7)], "domain string, ts double, number int").write.parquet(folder)
    stream = spark.readStream.schema("domain string, ts double, number int").parquet(folder)
    query = incremental.rate_limited(stream).writeStream.format("memory").queryName("edges_of_limits").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("edges_of_limits")
    assert sorted(map(tuple, got.collect()), key=repr) == [("a", 1.0, 1.0), (None, 2.0, 2.0)]
    assert got.columns == ["domain", "ts", "allowed_at"] and got.where(F.col("allowed_at").isNull()).count() == 0
