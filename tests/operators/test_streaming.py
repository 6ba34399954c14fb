from datetime import datetime, timedelta

import pytest

from landledger import streaming

DAY = datetime(2026, 9, 1)


def run(df, sink, mode="append"):
    q = df.writeStream.format("memory").queryName(sink).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(sink).collect()


def test_windowed_yield_and_first_sightings(spark, tmp_path):
    rows = [(DAY + timedelta(days=d), k, 1.0) for d, k in ((0, "a"), (1, "a"), (8, "b"), (30, "a"))]
    spark.createDataFrame(rows, "ts timestamp, k string, v double").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, k string, v double").parquet(f"file://{tmp_path}/in")
    got = run(streaming.windowed_yield(stream, "ts", "k", "v"), "yield_out", "complete")
    assert sum(r["n"] for r in got) == 4
    assert sorted(r["k"] for r in run(streaming.first_sightings(stream, "ts", ["k"]), "first_out")) == ["a", "b"]


SIGHTING = "property_id long, source_id long, verifies boolean, visible boolean, seq long, ts timestamp"


@pytest.fixture
def rocks(spark):
    spark.conf.set(streaming.STATE_STORE, streaming.ROCKS_DB)
    yield spark
    spark.conf.unset(streaming.STATE_STORE)


def test_running_status_equals_the_batch_rule(rocks, tmp_path):
    rows = [(1, 1, True, True, 0), (1, 2, True, True, 1), (1, 1, True, False, 2), (1, 2, True, False, 3), (1, 9, False, True, 4)]
    rocks.createDataFrame([(*r, DAY + timedelta(hours=r[4])) for r in rows], SIGHTING).coalesce(1).write.parquet(f"file://{tmp_path}/log")
    stream = rocks.readStream.schema(SIGHTING).parquet(f"file://{tmp_path}/log")
    got = run(streaming.running_status(stream), "status_out")
    assert [r["status"] for r in sorted(got, key=lambda r: r["ts"])] == ["active", "active", "active", "removed", "discovered"]


def test_silence_revival_late_rows_and_forgetting(rocks, tmp_path):
    """Batches a while apart: stale after 45 days, revived into what its sources showed, late rows dropped, forgotten after 180 days."""
    days = [(0, 1, 1, True, True), (1, 1, 2, True, True), (60, 2, 1, True, True), (61, 1, 1, True, False), (10, 1, 2, True, False), (300, 2, 1, True, True), (301, 1, 9, False, True), (302, 2, 1, True, True)]
    for k, (day, p, source, verifies, visible) in enumerate(days):
        rocks.createDataFrame([(p, source, verifies, visible, k, DAY + timedelta(days=day))], SIGHTING).coalesce(1).write.parquet(f"file://{tmp_path}/log/{k}")
    stream = rocks.readStream.schema(SIGHTING).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/log")
    got = [(r["property_id"], (r["ts"] - DAY).days, r["status"]) for r in run(streaming.running_status(stream), "silence_out")]
    # 1: shown by two, stale; one takes it off while the other still shows it; the late absence of day 10 is dropped; stale again, forgotten, found anew.
    assert sorted(x for x in got if x[0] == 1) == [(1, 0, "active"), (1, 1, "active"), (1, 1, "stale"), (1, 61, "stale"), (1, 301, "discovered")]
    assert (2, 60, "active") in got and (2, 60, "stale") in got and (2, 300, "active") in got
