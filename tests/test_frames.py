import json

from pyspark.sql import functions as F, types as T

from livetick import schema as S
from livetick.operators import bands, hosts, rollups, telemetry
from livetick.sources import frames
from livetick.sources.tables import (
    bind, from_points, host_dimension, read_table, read_ticks, static_series, to_points, write_ticks, Binding,
)

TICK = "ts_us bigint, host string, cpu_avg double, cpu_sd double, cpu_n bigint, n_current bigint, " \
       "anomalies_above array<bigint>, anomalies_below array<bigint>"
NONE = [0] * 5


def test_batch_unpack(spark):
    batches = spark.createDataFrame([
        ([(1_700_000_000_000, 0.5, 100, "api-1"), (1_700_000_000_050, 0.6, 110, "api-2")],), ([],),
    ], S.EVENT_BATCH)
    rows = frames.unpack_batches(batches).collect()
    assert [(r.host, r.cpu) for r in rows] == [("api-1", 0.5), ("api-2", 0.6)]
    assert rows[0].time.timestamp() == 1_700_000_000


def test_raw_frames_round_trip_and_ignore_other_types(spark, make_events):
    events = make_events([(1_700_000_000_000 + i, i / 7, i, "api-1") for i in range(25)])
    batches = frames.event_batches(events, 10)
    assert batches.select(F.max(F.size("events"))).first()[0] == 10
    encoded = frames.append_frames(batches).select("frame")
    noise = spark.createDataFrame([('{"type":"aggregate-append","rows":[{"host":"x"}]}',), ('{"type":"append","rows":[]}',)], "frame string")
    rows = frames.decode_events(encoded.unionByName(noise)).orderBy("time_ms").collect()
    assert [(r.type, r.time_ms, r.cpu, r.requests, r.host) for r in rows] == [
        ("append", 1_700_000_000_000 + i, i / 7, i, "api-1") for i in range(25)]
    snap = frames.snapshot_frames(events, 10).collect()
    assert len(snap) == 3 and all(json.loads(r.frame)["type"] == "snapshot" for r in snap)


def test_aggregate_frames(spark):
    ticks = spark.createDataFrame([
        (1_000_000, "api-2", None, None, 0, 0, NONE, NONE), (1_000_000, "api-1", 0.5, 0.1, 9, 2, [1, 0, 0, 0, 0], NONE),
        (1_200_000, "api-1", 0.7, 0.1, 9, 1, NONE, NONE),
    ], TICK)
    encoded = frames.aggregate_frames(ticks).orderBy("ts_us").collect()
    assert [(r.ts_us, r.n_rows) for r in encoded] == [(1_000_000, 2), (1_200_000, 1)]
    first = json.loads(encoded[0].frame)
    assert first["type"] == "aggregate-append" and [r["host"] for r in first["rows"]] == ["api-1", "api-2"]
    back = frames.decode_ticks(frames.aggregate_frames(ticks)).filter("host = 'api-2'").first()
    assert (back.ts, back.cpu_avg, back.cpu_sd, back.cpu_n) == (1_000, None, None, 0)
    snap = json.loads(frames.aggregate_snapshot(ticks).orderBy("ts_us").first().frame)
    assert snap["thresholds"] == [1, 1.5, 2, 2.5, 3] and snap["type"] == "aggregate-snapshot"


def test_latest_per_host(spark):
    ticks = spark.createDataFrame([
        (1_000, "api-1", 0.5, 0.1, 9, 1, NONE, NONE), (1_000, "api-2", 0.4, 0.1, 9, 1, NONE, NONE),
        (1_200, "api-1", 0.7, 0.1, 9, 1, NONE, NONE),
    ], TICK)
    got = {r.host: (r.ts_us, r.cpu_avg) for r in rollups.latest_per(ticks, ["host"]).collect()}
    assert got == {"api-1": (1_200, 0.7), "api-2": (1_000, 0.4)}


def test_frame_fanin(spark):
    ticks = spark.createDataFrame([(1, 2), (1, 3), (1, 1), (2, 0), (2, 0)], "ts_us bigint, cpu_n bigint")
    rows = telemetry.frame_fanin(ticks, 1).orderBy("ts_us").collect()
    assert [(r.frame_events, r.total_frames, r.total_events, r.fan_in) for r in rows] == [(6, 1, 6, 6.0), (0, 2, 6, 3.0)]


def test_schema_contract(spark):
    assert S.contract_differences(S.EVENT, S.WIRE_EVENT) == []
    wrong = T.StructType([T.StructField("time", T.StringType()), T.StructField("cpus", T.DoubleType()), T.StructField("requests", T.StringType())])
    assert [d[1] for d in S.contract_differences(S.EVENT, wrong)] == ["time", "cpu", "requests", "host"]
    df = spark.createDataFrame([(1, None)], "a bigint, b string")
    report = {r.field: (r.actual_kind, r.n_null, r.ok) for r in S.contract_report(df, T.StructType([
        T.StructField("a", T.DoubleType(), False), T.StructField("b", T.StringType(), False), T.StructField("c", T.StringType()),
    ])).collect()}
    assert report == {"a": ("number", 0, True), "b": ("string", 1, False), "c": ("missing", 1, False)}


def test_hosts(spark, make_events):
    events = make_events([(0, 1, 1, h) for h in ("z", "api-2", "api-1", "b")])
    dim = host_dimension(spark, list(S.DEFAULT_HOSTS))
    assert [r.host for r in hosts.discover(events, dim).orderBy("rank").collect()] == ["api-1", "api-2"]
    assert [r.host for r in hosts.ranked_hosts(events, dim).collect()] == ["api-1", "api-2", "b", "z"]
    off = host_dimension(spark, ["z"])
    assert {r.host for r in hosts.enabled(events, off).collect()} == {"api-1", "api-2", "b"}
    assert hosts.high_value(events, 1.0, off).count() == 0  # strictly above


def test_bands_gate_and_visibility(spark):
    ticks = spark.createDataFrame([
        (1, "a", 0.5, 0.1, 29, 1, NONE, NONE), (2, "a", 0.5, 0.1, 30, 1, [3, 1, 0, 0, 0], NONE), (1, "b", 0.5, 0.1, 99, 1, [9] * 5, NONE),
    ], TICK)
    rows = {r.ts_us: (r.smooth, r.upper, r.lower) for r in bands.bands(ticks, 2.0).collect()}
    assert rows == {1: (None, None, None), 2: (0.5, 0.7, 0.3)}
    dots = bands.anomaly_dots(ticks, 1.25).collect()
    assert [(r.ts_us, r.side, r.n_at_sigma) for r in dots] == [(2, "above", 2.0)]


def test_axis_domain(spark):
    flat = spark.createDataFrame([(0.5, 0.5)], "a double, b double")
    row = bands.axis_domain(flat, ["a", "b"]).first()
    assert (row.y_min, row.y_max) == (0.45, 0.55)
    wide = spark.createDataFrame([(0.0, 10.0), (None, 4.0)], "a double, b double")
    row = bands.axis_domain(wide, ["a", "b"], y_max=20).first()
    assert (row.lo, row.hi, row.y_min, row.y_max) == (0.0, 10.0, 0.0, 20.0)


def test_bars_touching_the_axis_are_kept(make_events):
    bars = rollups.bucket_counts(make_events([(0, 1, 1, "a"), (16_000, 1, 1, "a"), (31_000, 1, 1, "a")]), "15s")
    kept = rollups.clip_bars(bars, F.lit(15_000_000), F.lit(29_000_000)).orderBy("begin_us").collect()
    assert [(r.begin_us, r.mid_us, r.n) for r in kept] == [(0, 7_500_000, 1), (15_000_000, 22_500_000, 1)]


def test_subscriber_without_history(spark):
    frame = json.loads(frames.empty_aggregate_snapshot(spark).first().frame)
    assert frame == {"type": "aggregate-snapshot", "thresholds": [1, 1.5, 2, 2.5, 3], "rows": []}
    assert frames.decode_ticks(frames.empty_aggregate_snapshot(spark)).count() == 0


def test_tables_in_other_formats(spark, make_events, tmp_path):
    rows = make_events([(1_500, 0.5, 3, "a"), (2_500, 0.25, 4, "b")]).selectExpr("ts AS time", "cpu", "requests", "host")
    for fmt in ("json", "csv", "parquet"):
        rows.write.format(fmt).save(str(tmp_path / fmt))
        back = read_table(spark, str(tmp_path / fmt), S.EVENT, fmt)
        bound = bind(back, Binding(ts="time", host="host", cpu="cpu", requests="requests")).orderBy("ts")
        assert [(r.ts_us, r.cpu, r.requests, r.host) for r in bound.collect()] == [
            (1_500_000, 0.5, 3, "a"), (2_500_000, 0.25, 4, "b")]


def test_tick_table_by_day(spark, tmp_path):
    day = 86_400_000_000
    ticks = spark.createDataFrame([(d * day + i, "a", 0.5, 0.1, 9, 1, NONE, NONE) for d in range(3) for i in (1, 2)], TICK)
    write_ticks(ticks, str(tmp_path / "t"))
    assert sorted(map(tuple, read_ticks(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, ticks.collect()))
    some = read_ticks(spark, str(tmp_path / "t"), "1970-01-02", "1970-01-02")
    assert [r.ts_us for r in some.orderBy("ts_us").collect()] == [day + 1, day + 2]
    assert "PartitionFilters: [isnotnull(day" in some._jdf.queryExecution().toString()


def test_points_and_static_series(spark):
    line = static_series(spark, [(2, 0.7), (1, 0.7)])
    typed = from_points(line, T.StructType([T.StructField("ts_ms", T.LongType()), T.StructField("value", T.FloatType())]))
    assert [(f.name, f.dataType.simpleString()) for f in typed.schema] == [("ts_ms", "bigint"), ("value", "float")]
    assert [r.ts_ms for r in to_points(line, "ts_ms", "value").collect()] == [1, 2]
