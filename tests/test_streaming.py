"""Streaming runs give the batch rows, across restarts, with each tick once."""

import pytest
from pyspark.sql import functions as F

from livetick.operators.ticks import host_ticks
from livetick.sources import frames
from livetick.sources.tables import EVENTS, read_events
from livetick.streaming import sinks
from livetick.streaming.sources import bind_stream, file_stream
from livetick.streaming.ticks import stream_host_ticks

COLUMNS = ["host", "cpu_n", "n_current", "anomalies_above", "anomalies_below"]


@pytest.fixture
def feed(spark, data_dir, tmp_path):
    """A folder of event files; ``put(i)`` delivers the i-th third of the stream."""
    table = spark.read.parquet(f"{data_dir}/events.parquet")
    n = table.count()
    folder = str(tmp_path / "in")

    def put(i):
        part = table.filter((F.col("event_id") >= i * n // 3) & (F.col("event_id") < (i + 1) * n // 3))
        part.coalesce(1).write.mode("append").parquet(folder)

    def stream():
        return bind_stream(file_stream(spark, folder, table.schema, files_per_trigger=1), EVENTS, "10 minutes")

    return put, stream


def run_ticks(stream, tmp_path):
    ticks = stream_host_ticks(stream, "1h", "24h", salts=3)
    sinks.to_files(ticks, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()


def rows_of(df, ts):
    return sorted((r[ts], r.host, round(r.cpu_avg, 6), round(r.cpu_sd, 6), r.cpu_n, r.n_current,
                   tuple(r.anomalies_above), tuple(r.anomalies_below)) for r in df.collect())


def test_stream_equals_batch_across_a_restart(spark, data_dir, tmp_path, feed):
    put, stream = feed
    put(0)
    put(1)
    run_ticks(stream, tmp_path)
    first = spark.read.parquet(str(tmp_path / "out")).count()
    run_ticks(stream, tmp_path)  # nothing new: no output
    assert spark.read.parquet(str(tmp_path / "out")).count() == first > 0
    put(2)
    run_ticks(stream, tmp_path)
    got = spark.read.parquet(str(tmp_path / "out")).withColumn("ts_us", F.expr("unix_micros(ts)"))
    assert got.count() == got.select("ts_us", "host").distinct().count() > first
    events = read_events(spark, data_dir)
    closed = events.agg(F.max("ts_us")).first()[0] - 600_000_000
    want = host_ticks(events, "1h", "24h").filter(F.col("ts_us") <= closed)
    assert rows_of(got, "ts_us") == rows_of(want, "ts_us")


def test_frames_and_observers(spark, data_dir, tmp_path, feed):
    put, stream = feed
    put(0)
    put(1)
    seen = []
    sinks.observe(stream().filter("cpu > 70"), lambda df, i: seen.append(df.count()), str(tmp_path / "cp1")).awaitTermination()
    sinks.to_append_frames(stream(), str(tmp_path / "fr"), str(tmp_path / "cp2"), batch_rows=50).awaitTermination()
    decoded = frames.decode_events(spark.read.text(str(tmp_path / "fr")).withColumnRenamed("value", "frame"))
    table = read_events(spark, data_dir)
    n = table.count()
    assert decoded.count() == table.filter(F.col("seq") < 2 * n // 3).count()
    assert sum(seen) == spark.read.parquet(f"{tmp_path}/in").filter("value > 70").count()


def test_redelivery_is_merged(spark, tmp_path, feed):
    put, stream = feed
    put(0)
    merged = sinks.merge_resumed(stream(), stream())
    sinks.to_files(merged, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("seq").distinct().count() == spark.read.parquet(f"{tmp_path}/in").count()


def test_events_behind_the_watermark_are_rejected(spark, tmp_path, feed):
    put, stream = feed
    put(2)
    run_ticks(stream, tmp_path)
    before = spark.read.parquet(str(tmp_path / "out")).count()
    put(0)  # a month late
    run_ticks(stream, tmp_path)
    assert spark.read.parquet(str(tmp_path / "out")).count() == before


@pytest.mark.parametrize("name", ["stream_frames", "stream_resume", "stream_high_filter", "stream_host_ticks", "stream_retention", "stream_global_ticks", "stream_snapshot"])
def test_registered_streams_read_a_folder_in_several_batches(spark, data_dir, tmp_path, name, monkeypatch):
    from livetick.plans import stream_queries

    table = spark.read.parquet(f"{data_dir}/events.parquet")
    for i in range(4):
        part = table.orderBy("event_id").offset(i * table.count() // 4).limit(table.count() // 4)
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/sf/events.parquet")
    monkeypatch.setattr(stream_queries, "FILES_PER_TRIGGER", 1)
    query = getattr(stream_queries, name)
    got = [tuple(r) for r in query(spark, f"{tmp_path}/sf").collect()]
    want = [tuple(r) for r in query(spark, data_dir).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and got


def test_deviation_keeps_its_digits_far_from_zero(spark, data_dir, tmp_path, feed):
    put, stream = feed
    for i in range(3):
        put(i)
    outs = []
    for shift in (0, 10**9):
        ticks = stream_host_ticks(lambda shift=shift: stream().withColumn("cpu", F.expr(f"cpu + {shift}D")), "1h", "24h")
        sinks.to_files(ticks, f"{tmp_path}/out{shift}", f"{tmp_path}/cp{shift}").awaitTermination()
        outs.append(spark.read.parquet(f"{tmp_path}/out{shift}"))
    pairs = outs[0].alias("a").join(outs[1].alias("b"), ["ts", "host"])
    assert pairs.filter("abs(a.cpu_sd - b.cpu_sd) > 1e-5 OR a.anomalies_above <> b.anomalies_above OR a.anomalies_below <> b.anomalies_below").count() == 0
    assert pairs.count() == outs[0].count() > 0
