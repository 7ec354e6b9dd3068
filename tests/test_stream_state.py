"""Keyed state on the stream against the batch operators, over several micro-batches."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from livetick.operators import ordering, telemetry
from livetick.operators.ticks import host_ticks
from livetick.streaming import sinks, state
from livetick.streaming.sources import file_stream
from livetick.streaming.ticks import stream_host_ticks

RANDOM = random.Random(21)


@pytest.fixture
def feed(spark, make_events, tmp_path):
    """``put(rows)`` delivers (ms, cpu, requests, host) rows as one file; ``stream(delay)`` reads a file a micro-batch."""
    folder, sent = str(tmp_path / "in"), []

    def put(rows):
        # Nothing lies at the epoch, which a stream without any watermark yet takes for late.
        rows = [(ms + 60_000, *rest) for ms, *rest in rows]
        first = len(sent)
        sent.extend(rows)
        events = make_events(rows).withColumn("seq", F.col("seq") + first)
        events.coalesce(1).write.mode("append").parquet(folder)
        return events

    def stream(delay="0 seconds"):
        schema = spark.read.parquet(folder).schema
        return file_stream(spark, folder, schema, files_per_trigger=1).withWatermark("ts", delay)

    return put, stream, sent


def rows_of(spark, df, tmp_path, name="out"):
    sinks.to_files(df, str(tmp_path / name), str(tmp_path / f"{name}-cp")).awaitTermination()
    return spark.read.schema(df.schema).parquet(str(tmp_path / name))


@pytest.mark.parametrize("width", [1, 2, 7, 300])
def test_windows(width):
    k = np.array(sorted(RANDOM.sample(range(0, 900), 60)) + [5000, 5001, 9000])
    buckets = np.zeros(len(k), state._BUCKET)
    buckets["k"], buckets["n"] = k, np.random.default_rng(1).integers(1, 9, len(k))
    buckets["mean"], buckets["m2"] = 1e9 + np.random.default_rng(2).random(len(k)), np.random.default_rng(3).random(len(k))
    ticks = np.array([t for t in range(0, 9001) if any(t - width < b <= t for b in k)])
    found = state.windows(buckets, ticks, width)
    for row in found:
        own = buckets[(k > row["k"] - width) & (k <= row["k"])]
        mean = np.average(own["mean"], weights=own["n"])
        assert row["n"] == own["n"].sum() and row["mean"] == pytest.approx(mean, abs=1e-6)
        assert row["m2"] == pytest.approx((own["m2"] + own["n"] * (own["mean"] - mean) ** 2).sum(), rel=1e-6, abs=1e-5)


def test_ring_equals_batch_at_300_ticks_a_window(spark, make_events, feed, tmp_path):
    """200 ms ticks over one minute, silences longer than the window, hosts that stop."""
    put, stream, sent = feed
    for start in (0, 20_000, 40_000, 150_000):
        put(sorted((start + RANDOM.randrange(20_000), RANDOM.gauss(50, 5), 1, RANDOM.choice("ab" if start < 40_000 else "bc")) for _ in range(200)))
    ticks = stream_host_ticks(stream, "200ms", "1m", salts=2)
    got = rows_of(spark, ticks, tmp_path).selectExpr("unix_micros(ts) AS ts_us", "host", "cpu_n", "n_current", "anomalies_above", "anomalies_below", "round(cpu_avg, 8) AS a", "round(cpu_sd, 8) AS s")
    want = host_ticks(make_events(sent), "200ms", "1m").selectExpr(*["ts_us", "host", "cpu_n", "n_current", "anomalies_above", "anomalies_below", "round(cpu_avg, 8) AS a", "round(cpu_sd, 8) AS s"])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_baseline_alone_of_a_reader_who_drops_the_counts(spark, feed, tmp_path):
    put, stream, _ = feed
    put([(i * 100, float(i), 1, "a") for i in range(100)])
    ticks = stream_host_ticks(stream, "1s", "3s").select("ts", "host", "cpu_n")
    assert rows_of(spark, ticks, tmp_path).count() == 9


def test_retention_keeps_bounded_state(spark, make_events, feed, tmp_path):
    put, stream, sent = feed
    for i in range(6):
        put([(i * 10_000 + RANDOM.randrange(10_000) // 5 * 5, 1.0, 1, RANDOM.choice("aab")) for _ in range(150)] + [((i + 1) * 10_000, 1.0, 1, "a")])
    moves = rows_of(spark, state.stream_retention(stream(), "12s", "2s", salts=3), tmp_path)
    got = moves.groupBy("host").agg(F.expr("sum(added) - sum(evicted) AS kept"), F.sum("evicted").alias("evicted"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ordering.retention(make_events(sent), "12s").collect()))
    # Between two watermarks a key holds the events of the age and of one micro-batch, whatever came before.
    most = moves.agg(F.max("held"), F.max("slices")).first()
    assert most[0] < 6 * 151 / 2 and most[1] <= (12 + 10) / 2 + 2


def test_late_events_are_rejected_strictly(spark, make_events, feed, tmp_path):
    put, stream, sent = feed
    for i in range(4):
        put([(i * 1000 + RANDOM.randrange(1500), 1.0, 1, "a") for _ in range(60)])
    for _ in range(2):  # the second run finds nothing new
        sinks.reject_late(stream("1 hour"), str(tmp_path / "out"), str(tmp_path / "cp"), "seq").awaitTermination()
    got = {kind: {r.seq for r in spark.read.parquet(f"{tmp_path}/out/{kind}").collect()} for kind in ("accepted", "rejected")}
    assert got["accepted"] == {r.seq for r in ordering.late_filter(make_events(sent), "seq").collect()}
    assert got["rejected"] == set(range(len(sent))) - got["accepted"] and got["rejected"]


def test_fifo_pairs_over_micro_batches(spark, tmp_path):
    """Emissions without an arrival are ignored, arrivals wait over micro-batches and expire."""
    folder = str(tmp_path / "in")
    schema = "seq bigint, key string, at_us bigint, emitted boolean"
    batches = [[(0, "a", False), (10, "a", False), (20, "b", True), (30, "a", True)], [(40, "a", False), (50, "a", True), (60, "b", False)],
               [(70, "a", True), (80, "a", True), (20_000, "c", False)], [(40_000, "c", False), (40_001, "a", False), (40_002, "a", True)]]
    done = 0
    for rows in batches:
        moves = [(done + i, key, (ms + 1000) * 1000, out) for i, (ms, key, out) in enumerate(rows)]
        done += len(rows)
        spark.createDataFrame(moves, schema).withColumn("ts", F.expr("timestamp_micros(at_us)")).coalesce(1).write.mode("append").parquet(folder)
    stream = file_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1).withWatermark("ts", "0 seconds")
    got = rows_of(spark, state.stream_fifo(stream, {"key": "string"}, "10s"), tmp_path)
    pairs = sorted((r.key, r.rn, r.seq, r.emit_seq, r.latency_us) for r in got.filter("emit_seq IS NOT NULL").collect())
    assert pairs == [("a", 1, 0, 3, 30_000), ("a", 2, 1, 5, 40_000), ("a", 3, 4, 7, 30_000), ("a", 4, 11, 12, 1_000)]
    assert sorted((r.key, r.rn, r.seq) for r in got.filter("emit_seq IS NULL").collect()) == [("b", 1, 6), ("c", 1, 9)]


def test_fifo_equals_batch(spark, make_events, tmp_path):
    events = make_events([(1000 + i * 10, RANDOM.random(), 1, RANDOM.choice("ab")) for i in range(300)])
    arrivals = events.selectExpr("host", "seq", "ts_us AS at_us")
    emissions = events.filter("cpu < 0.8").selectExpr("host", "seq", "ts_us + 500 AS at_us")
    moves = arrivals.selectExpr("*", "false AS emitted").unionByName(emissions.selectExpr("*", "true AS emitted")).withColumn("ts", F.expr("timestamp_micros(at_us)"))
    for i in range(3):
        moves.filter(f"seq >= {i * 100} AND seq < {i * 100 + 100}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = file_stream(spark, f"{tmp_path}/in", moves.schema, files_per_trigger=1).withWatermark("ts", "1 second")
    got = rows_of(spark, state.stream_fifo(stream, {"host": "string"}, "1h"), tmp_path).collect()
    want = telemetry.fifo_pairs(arrivals, emissions, ["host"]).collect()
    assert sorted((r.host, r.rn, r.seq, r.emit_seq, r.latency_us) for r in got) == sorted((r.host, r.rn, r.seq, r.emit_seq, r.latency_us) for r in want)


def test_global_clock_over_silences(spark, make_events, feed, tmp_path):
    put, stream, sent = feed
    for start in (0, 3_000, 60_000, 61_000):
        put(sorted((start + RANDOM.randrange(1000), 1.0, 1, RANDOM.choice("ab")) for _ in range(50)))
    got = rows_of(spark, state.stream_global_ticks(stream(), "200ms", "2s"), tmp_path)
    want = telemetry.global_ticks(make_events(sent), "200ms", "2s")
    assert sorted((r.t, r.events_ingested_total, r.n / 0.2, r.evicted_total) for r in got.withColumn("t", F.expr("unix_micros(at) + 1")).collect()) == sorted(
        (r.ts_us, r.events_ingested_total, r.events_per_sec, r.evicted_total) for r in want.collect())


def test_late_subscriber_gets_each_tick_once(spark, make_events, feed, tmp_path):
    put, stream, sent = feed
    path, schema = str(tmp_path / "history"), None
    seen = []
    for i in range(3):
        put(sorted((i * 10_000 + RANDOM.randrange(10_000), RANDOM.random(), 1, RANDOM.choice("ab")) for _ in range(80)))
        ticks = state.stream_global_ticks(stream(), "1s", "5s")
        schema = ticks.schema
        sinks.to_history(ticks, path, str(tmp_path / "cp")).awaitTermination()
        seen.append(spark.read.parquet(path).agg(F.max("micro_batch")).first()[0])
    joined = seen[1]
    history, later = sinks.handover(spark, path, schema, joined)
    assert history.count() > 0 and later.count() > 0
    assert history.agg(F.max("at")).first()[0] < later.agg(F.min("at")).first()[0]
    got = history.unionByName(later).withColumn("ts_us", F.expr("unix_micros(at) + 1"))
    want = telemetry.global_ticks(make_events(sent), "1s", "5s")
    assert sorted((r.ts_us, r.events_ingested_total) for r in got.collect()) == sorted((r.ts_us, r.events_ingested_total) for r in want.collect())


def test_snapshots_are_throttled(spark, make_events, feed, tmp_path):
    put, stream, sent = feed
    path = str(tmp_path / "snap")
    put([(0, 1.0, 1, "a"), (5, 2.0, 1, "b"), (5, 3.0, 1, "b")])
    start = time.time()
    query = sinks.snapshots(stream(), path, str(tmp_path / "cp"), ["host"], ["ts", "seq"], every="3 seconds")
    try:
        for i in range(1, 5):
            put([(i * 100, float(i), i, RANDOM.choice("ac")), (i * 100 - 50, -1.0, 0, "a")])
            time.sleep(1)
        deadline = time.time() + 60
        while time.time() < deadline:
            query.processAllAvailable()
            if sinks.newest_snapshot(spark, path).agg(F.max("ts_us")).first()[0] == max(r[0] for r in sent) * 1000:
                break
    finally:
        query.stop()
        query.awaitTermination()
    written = max(int(p.name.partition("=")[2]) for p in (tmp_path / "snap").glob("snapshot=*")) + 1
    assert written <= (time.time() - start) / 3 + 2
    newest = {}
    for i, (ms, cpu, _, host) in enumerate(sent):
        newest[host] = max(newest.get(host, (-1, -1, 0)), (ms, i, cpu))
    assert {r.host: (r.ts_us // 1000, r.seq, r.cpu) for r in sinks.newest_snapshot(spark, path).collect()} == newest
    assert len(list((tmp_path / "snap").glob("snapshot=*"))) <= 2
