"""Order-sensitive operators with chunks far smaller than the data."""

import random
import statistics

import pandas as pd
import pytest

from livetick.functions.timecols import grid
from livetick.operators import custom, grid as gridding, ordering, rollups, smoothing, telemetry
from livetick.operators.running import ranked, running
from livetick.plans import event_queries
from livetick.sources.validate import accept, split_required


@pytest.fixture
def numbers(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.5 else rng.choice("abc"), rng.randrange(-50, 50)) for i in range(500)]
    return rows, spark.createDataFrame(rows, "seq bigint, host string, v bigint")


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running_equals_a_sequential_pass(numbers, descending, exclusive):
    rows, df = numbers
    got = {r.seq: (r.total, r.top, r.low) for r in running(
        df, ["host"], "seq", grid("seq", 17),
        {"total": ("sum", "v"), "top": ("max", "v"), "low": ("min", "v")}, descending, exclusive,
    ).collect()}
    seen = {}
    for seq, host, v in reversed(rows) if descending else rows:
        before = list(seen.setdefault(host, []))
        seen[host].append(v)
        part = before if exclusive else seen[host]
        assert got[seq] == (sum(part), max(part, default=None), min(part, default=None))


def test_ranked(numbers):
    rows, df = numbers
    got = {r.seq: r.rn for r in ranked(df, ["host"], "seq", 13).collect()}
    count = {}
    for seq, host, _ in rows:
        count[host] = count.get(host, 0) + 1
        assert got[seq] == count[host]


@pytest.mark.parametrize("alpha, chunk", [(0.25, 10_000), (0.9, 37), (0.6, 100)])
def test_ema_equals_the_recursion(spark, alpha, chunk):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "hot", "hot"]), rng.random() * 100) for i in range(3_000)]
    df = spark.createDataFrame(rows, "seq bigint, host string, cpu double")
    got = {r.seq: (r.ema, r.pos) for r in smoothing.ema(df, ["host"], "cpu", alpha, chunk_rows=chunk).collect()}
    state, pos = {}, {}
    for seq, host, x in rows:
        state[host] = x if host not in state else alpha * x + (1 - alpha) * state[host]
        pos[host] = pos.get(host, 0) + 1
        assert got[seq][0] == pytest.approx(state[host], rel=1e-12) and got[seq][1] == pos[host]


def test_ema_last(spark):
    rng = random.Random(8)
    values = [rng.random() for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "seq bigint, cpu double")
    want = pd.Series(values).ewm(alpha=0.3, adjust=False).mean().iloc[-1]
    for chunk in (10_000, 7):
        assert smoothing.ema_last(df, "cpu", 0.3, chunk).first().trend == pytest.approx(want, rel=1e-12)


def test_after_warm_up(spark):
    df = spark.createDataFrame([(i, "a", float(i)) for i in range(15)], "seq bigint, host string, cpu double")
    rows = smoothing.after_warm_up(smoothing.ema(df, ["host"], "cpu", 0.25), 12).collect()
    assert sorted(r.seq for r in rows) == [12, 13, 14]


def test_late_filter(spark):
    rng = random.Random(1)
    rows = [(i, max(0, i * 10 - rng.choice([0, 0, 0, 50, 200]))) for i in range(400)]
    df = spark.createDataFrame(rows, "arrival bigint, ts_us bigint")
    newest, want = -1, []
    for arrival, ts in rows:
        if ts >= newest:
            newest = ts
            want.append(arrival)
    got = [r.arrival for r in ordering.late_filter(df, "arrival", chunk_rows=11).orderBy("arrival").collect()]
    assert got == want and len(want) < 400
    with pytest.raises(Exception, match="older than the newest"):
        ordering.late_filter(df, "arrival", policy="fail", chunk_rows=11).collect()


def test_equal_times_are_accepted(spark):
    df = spark.createDataFrame([(0, 5), (1, 5), (2, 4), (3, 5)], "arrival bigint, ts_us bigint")
    assert [r.arrival for r in ordering.late_filter(df, "arrival").orderBy("arrival").collect()] == [0, 1, 3]


def test_resume_merge_keeps_each_event_once(make_events):
    events = make_events([(t, t, 1, "a") for t in (1, 2, 3, 3, 4, 5)])
    held, incoming = events.filter("seq < 3"), events.filter("seq >= 1")
    assert sorted(r.seq for r in ordering.resume_merge(held, incoming).collect()) == [0, 1, 2, 3, 4, 5]


def test_snapshot_then_append(make_events):
    held = make_events([(1_700_000_000_000, 0.5, 1, "api-1")])
    later = make_events([(0, 0, 0, "x"), (1_700_000_001_000, 0.7, 1, "api-1")]).filter("seq = 1")
    rows = ordering.resume_merge(held, later).orderBy("ts").collect()
    assert len(rows) == 2 and rows[-1].cpu == 0.7


def test_retention_and_back_window(make_events):
    events = make_events([(t, 1, 1, "a") for t in (0, 50, 100, 150)])
    assert ordering.retention(events, "100ms").first().asDict() == {"host": "a", "kept": 2, "evicted": 2}
    shown = ordering.back_window(events, "100ms").collect()
    assert len(shown) == 3 and {(r.t_start_us, r.t_end_us) for r in shown} == {(50_000, 150_000)}


def test_grid_fill_carries_forward(make_events):
    rows = gridding.grid_fill(make_events([(0, 4, 1, "a"), (35, 8, 1, "a"), (36, 6, 1, "a")]), "10ms", 2).orderBy("ts_us").collect()
    assert [(r.ts_us, r.value, r.filled) for r in rows] == [
        (0, 4.0, 4.0), (10_000, None, 4.0), (20_000, None, 4.0), (30_000, 7.0, 7.0)]


def test_fifo_collision_gives_two_latencies(spark):
    schema = "host string, day bigint, seq bigint, at_us bigint"
    arrived = spark.createDataFrame([("a", 1, 0, 10), ("a", 1, 1, 12), ("a", 2, 2, 50)], schema)
    emitted = spark.createDataFrame([("a", 1, 7, 20), ("a", 1, 8, 30), ("b", 1, 9, 1)], schema)
    pairs = telemetry.fifo_pairs(arrived, emitted, ["host", "day"], chunk_rows=1)
    assert sorted(r.latency_us for r in pairs.collect()) == [10, 18]
    assert [(r.host, r.day, r.pending) for r in telemetry.fifo_residual(arrived, emitted, ["host", "day"]).collect()] == [("a", 2, 1)]


@pytest.mark.parametrize("n", [1, 2, 20, 100, 101])
def test_floor_percentiles(spark, n):
    rng = random.Random(n)
    values = [rng.randrange(-40, 40) for _ in range(n)]
    df = spark.createDataFrame([("m", v) for v in values], "metric string, v bigint")
    row = telemetry.floor_percentiles(df, ["metric"], "v", [50, 95, 99], chunks=7).first()
    ordered = sorted(values)
    assert [row.p50, row.p95, row.p99] == [ordered[min(n - 1, n * p // 100)] for p in (50, 95, 99)]
    whole = telemetry.floor_percentiles(df, [], "v", [50], chunks=7).first()
    assert (whole.n, whole.p50) == (n, row.p50)


def test_recent_ring_keeps_the_newest(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(m, i) for m in "ab" for i in range(30)], "metric string, at bigint")
    rows = telemetry.recent_ring(df, "metric", [F.col("at").desc()], capacity=5).collect()
    assert sorted((r.metric, r.at) for r in rows) == [(m, i) for m in "ab" for i in range(25, 30)]


def test_batch_stats_without_calls(spark):
    row = telemetry.batch_stats(spark.createDataFrame([], "size bigint"), "size").first()
    assert row.calls == 0 and row.events == 0 and row.avg_batch != row.avg_batch


def test_counter_deltas(spark):
    scrapes = spark.createDataFrame([("a", 10, 100, 5.0), ("a", 20, 160, 9.0), ("a", 30, 200, 7.0)],
                                    "host string, uptime bigint, ingested bigint, heap double")
    row = telemetry.counter_deltas(scrapes, ["host"], "uptime", ["ingested"], ["heap"]).first()
    assert (row.span, row.ingested_delta, row.ingested_rate, row.heap_peak) == (20, 100, 5.0, 9.0)


def test_top_n_and_keep(make_events):
    rows = rollups.top_n(make_events([(0, 1, 1, "a"), (1, 9, 1, "a"), (2, 5, 1, "a"), (3, 7, 1, "b"), (4, 7, 1, "b")]), "1s", 2).collect()
    assert {r.host: (r.cpu_keep, r.n, r.top) for r in rows} == {"a": (None, 3, [9.0, 5.0]), "b": (7.0, 2, [7.0, 7.0])}


def test_required_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 0.5, "b")], "seq int, cpu double, host string")
    assert [r.seq for r in accept(df, ["cpu", "host"]).collect()] == [2]
    tagged = {r.seq: (r.status, r.missing) for r in split_required(df, ["cpu", "host"]).collect()}
    assert tagged == {1: ("quarantine", ["cpu"]), 2: ("good", [])}
    with pytest.raises(Exception, match="required column"):
        accept(df, ["cpu"], policy="fail").collect()


def test_custom_reducer_and_partition_apply(spark, numbers):
    rows, df = numbers
    got = {r.host: r.reduced for r in custom.custom_reduce(
        df, "host", "v", lambda s: [float(s.max()), float(s.min())],
        lambda a, b: [max(a[0], b[0]), min(a[1], b[1])], lambda s: s[0] - s[1]).collect()}
    for host in {r[1] for r in rows}:
        values = [r[2] for r in rows if r[1] == host]
        assert got[host] == max(values) - min(values)
    calls = custom.partition_apply(
        df, "host", lambda pdf: pd.DataFrame({"host": [pdf.host[0]], "mid": [pdf.v.median()]}), "host string, mid double")
    want = pd.DataFrame(rows).groupby(1)[2].median().to_dict()
    assert {r.host: r.mid for r in calls.collect()} == pytest.approx(want)


def test_host_apply_gathers_no_host(spark, data_dir):
    plan = event_queries.host_apply(spark, data_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan


def test_middles(spark):
    draw = random.Random(4)
    rows = [(h, draw.choice([1.5, draw.gauss(0, 9)])) for h, n in (("a", 3001), ("b", 500), (None, 7), ("c", 1)) for _ in range(n)]
    rows += [("a", None), ("d", None), ("e", 2.0), ("e", 2.0)]
    frame = spark.createDataFrame(rows, "host string, v double").repartition(4)
    for df, want in ((frame, rows), (frame.limit(0), [])):
        got = {r.host: (r.mid, r.low, r.high, r.n) for r in rollups.middles(df, "host", "v", 20).collect()}
        lists = {h: sorted(v for x, v in want if x == h and v is not None) for h, _ in want}
        assert got == {h: (statistics.median(v) if v else None, v[0] if v else None, v[-1] if v else None,
                           sum(x == h for x, _ in want)) for h, v in lists.items()}


def test_custom_reducer_without_values(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", None), (None, 2.0), ("a", None)]
    df = spark.createDataFrame(rows, "host string, v double").repartition(8)

    def total(frame):
        got = custom.custom_reduce(frame, "host", "v", lambda s: [float(s.sum())], lambda a, b: [a[0] + b[0]], lambda s: s[0])
        return {r.host: r.reduced for r in got.collect()}

    assert total(df) == {"a": 4.0, "b": None, None: 2.0}
    assert total(df.filter("host = 'a'")) == {"a": 4.0}
    assert total(df.limit(0)) == {}


def test_resume_into_an_empty_series(make_events):
    incoming = make_events([(10, 0.1, 1, "a"), (20, 0.2, 1, "a")])
    assert ordering.resume_merge(incoming.limit(0), incoming).count() == 2


def test_grid_fill_over_a_long_gap(spark):
    events = spark.createDataFrame([(0, "a", 1.0), (2_000_000_000_000, "a", 5.0)], "ts_us bigint, host string, cpu double")
    filled = gridding.grid_fill(events, "1s").agg({"*": "count", "filled": "sum"}).first()
    assert filled["count(1)"] == 2_000_001 and filled["sum(filled)"] == 2_000_005.0


def test_newest_row_is_one_row_on_a_tie(spark):
    df = spark.createDataFrame([("a", 1, "x", None), ("a", 1, None, "y")], "host string, ts_us bigint, p string, q string")
    row = rollups.latest_per(df, ["host"]).first()
    assert (row.p, row.q) in {("x", None), (None, "y")}
