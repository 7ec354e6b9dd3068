"""Order statistics and moving averages against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from livetick.operators import baseline, ranks, rolling, rolling_ranks, smoothing

RANDOM = random.Random(11)


def floor_pct(values, p):
    return sorted(values)[min(len(values) - 1, len(values) * p // 100)]


@pytest.mark.parametrize("chunks", [2, 7, 256])
def test_order_statistics_of_doubles_within_one_unit(spark, chunks):
    """A key with a third of the rows, values that all lie in [0, 1], equal ones among them."""
    rows = [("hot", RANDOM.random()) for _ in range(400)] + [(f"h{i % 40}", RANDOM.choice([0.25, 0.5, RANDOM.random()])) for i in range(800)]
    rows += [(None, 0.5), (None, 0.75), ("null", None), ("nan", -0.5)]
    df = spark.createDataFrame(rows, "host string, v double")
    got = {r.host: (r.n, r.p0, r.p50, r.p99) for r in ranks.floor_percentiles(df, ["host"], "v", [0, 50, 99], chunks).collect()}
    by_key = {}
    for k, v in rows:
        if v is not None:
            by_key.setdefault(k, []).append(v)
    assert got == {k: (len(v), floor_pct(v, 0), floor_pct(v, 50), floor_pct(v, 99)) for k, v in by_key.items()}
    assert ranks.floor_percentiles(df.limit(0), ["host"], "v", [50]).count() == 0


def test_no_chunk_outweighs_the_others(spark):
    """Residuals of a narrow range would all fall into one chunk of value width."""
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, 'hot', concat('h', id % 50)) AS host", "pmod(xxhash64(id), 1000000) / 1000000D AS v")
    sizes = [r["count"] for r in ranks.with_chunk(df, "v", ranks.borders(df, "v", 64)).groupBy("_chunk").count().collect()]
    assert len(sizes) == 64 and max(sizes) < 2 * statistics.median(sizes)


def test_dense_ranks(spark):
    df = spark.createDataFrame([(v,) for v in [3.0, -1.0, 3.0, None, 0.5, 99.0, -7.25]], "v double")
    assert sorted(map(tuple, ranks.dense_ranks(df, "v", "r", 3).collect())) == [(-7.25, 0), (-1.0, 1), (0.5, 2), (3.0, 3), (99.0, 4)]


@pytest.mark.parametrize("chunks, distinct", [(3, 1), (3, 40), (256, 900)])
def test_rolling_ranks(spark, make_events, chunks, distinct):
    """Bursts at one instant, gaps longer than the window, window edges met exactly, nulls."""
    times = [RANDOM.randrange(0, 40) * 100 for _ in range(150)] + [700] * 30 + [RANDOM.randrange(90_000, 91_000) for _ in range(40)]
    rows = [(t, RANDOM.randrange(distinct) / 7, i, RANDOM.choice(["a", "a", "b"])) for i, t in enumerate(times)]
    events = make_events(rows).withColumn("cpu", F.when(F.col("seq") % 11 != 0, F.col("cpu")))
    got = rolling_ranks.rolling_quantiles(events, "500ms", {"median": rolling_ranks.MEDIAN, "p90": rolling_ranks.floor_percentile(90)}, chunks=chunks)
    want = []
    for i, (t, _, _, host) in enumerate(rows):
        window = [v for j, (u, v, _, h) in enumerate(rows) if h == host and t - 500 < u <= t and j % 11]
        want.append((i, *((len(window), statistics.median(window), floor_pct(window, 90)) if window else (None, None, None))))
    assert sorted(map(tuple, got.select("seq", "window_n", "median", "p90").collect())) == sorted(want)


@pytest.mark.parametrize("points, pieces, whole", [(8, 4, 0), (8, 64, 200), (64, 16, 0), (4096, 256, 0), (8, 4, 10_000), (4096, 256, 10_000)])
def test_rolling_ranks_of_small_segments(spark, make_events, points, pieces, whole):
    """Cores much larger than a segment, frequent values, a drift, crowded instants, sparse hosts, nulls."""
    rows = [(RANDOM.randrange(3_000), RANDOM.choice([0, 0, RANDOM.randrange(50)]), i, RANDOM.choice("aab")) for i in range(400)]
    rows += [(i * 7, i // 3, 0, "drift") for i in range(200)] + [(t, RANDOM.randrange(30), 0, "crowd") for t in (900, 1_400, 1_401) for _ in range(60)]
    rows += [(1_000_000 * i, i, 0, "sparse") for i in range(5)] + [(-700, 1, 0, "a")]
    events = make_events(rows).withColumn("cpu", F.when(F.col("seq") % 11 != 0, F.col("cpu")))
    ranks = {"lo": "(n - 1) div 2", "p90": "n * 90 div 100", "top": "n"}
    got = {(r.host, r.ts_us): (r.n, r.lo, r.p90, r.top) for r in rolling_ranks.rolling_ranks(events, "500ms", ranks, points=points, pieces=pieces, whole=whole).collect()}
    want = {}
    for t, _, _, host in rows:
        own = sorted(v for j, (u, v, _, h) in enumerate(rows) if h == host and t - 500 < u <= t and j % 11)
        if own:
            want[host, t * 1_000] = (len(own), own[(len(own) - 1) // 2], floor_pct(own, 90), own[-1])
    assert got == want


def test_rolling_ranks_take_as_many_jobs_whatever_the_values(spark):
    """The plan has no step for each digit of a value's rank."""
    jobs = []
    for distinct in (2, 5_000):
        spark.sparkContext.setJobGroup(f"ranks of {distinct}", "")
        events = spark.range(5_000).selectExpr("id AS seq", "timestamp_micros(id) AS ts", "id AS ts_us", "'one' AS host", f"double(id % {distinct}) AS cpu")
        rolling_ranks.rolling_ranks(events, "1ms", {"lo": "(n - 1) div 2"})
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"ranks of {distinct}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] > 0


def recursion(values, alpha):
    state, out = None, []
    for v in values:
        state = v if state is None else (1 - alpha) * state + alpha * v
        out.append(state)
    return out


@pytest.mark.parametrize("alpha", [1e-6, 0.01, 0.25, 0.999, 1 - 1e-12])
@pytest.mark.parametrize("block", [3, 10_000])
def test_ema_equals_the_recursion(spark, make_events, monkeypatch, alpha, block):
    monkeypatch.setattr(smoothing, "BLOCK_ROWS", block)
    values = [RANDOM.choice([0.0, 1e9, RANDOM.random()]) for _ in range(60)] + [0.0] * 100 + [RANDOM.random() for _ in range(40)]
    events = make_events([(i, v, 0, "a" if i % 3 else "b") for i, v in enumerate(values)])
    got = {(r.host, r.pos): r.ema for r in smoothing.ema(events, ["host"], "cpu", alpha, chunk_rows=17).collect()}
    for host in "ab":
        own = [v for i, v in enumerate(values) if (i % 3 > 0) == (host == "a")]
        for pos, want in enumerate(recursion(own, alpha), 1):
            assert got[host, pos] == pytest.approx(want, rel=1e-11, abs=0.0)
    last = smoothing.ema_last(events, "cpu", alpha, chunk_rows=17).first().trend
    assert last == pytest.approx(recursion(values, alpha)[-1], rel=1e-11)
    assert smoothing.ema_last(events.limit(0), "cpu", alpha).first().trend is None


@pytest.mark.parametrize("chunks", [2, 9, 256])
def test_baseline_of_a_burst_within_one_bucket(spark, make_events, chunks):
    """All instants of a host lie in one bucket of its window; chunks cut them, equal instants stay together."""
    rows = [(10_000 + i, RANDOM.gauss(1e6, 1), i, "burst") for i in range(300)] + [(10_100, 5.0, 0, "burst")] * 20
    rows += [(RANDOM.randrange(0, 60_000), RANDOM.random(), 0, "b") for _ in range(200)]
    got = {r.seq: (r.window_n, r.avg, r.sd) for r in baseline.event_baseline(make_events(rows), "20s", 2.0, chunks=chunks).collect()}
    for i, (t, _, _, host) in enumerate(rows):
        window = [v for u, v, _, h in rows if h == host and t - 20_000 < u <= t]
        assert got[i] == (len(window), pytest.approx(statistics.fmean(window), rel=1e-12), pytest.approx(statistics.pstdev(window), rel=1e-6, abs=1e-7))


def test_no_group_of_a_burst_outweighs_the_others(spark):
    events = spark.range(5_000).selectExpr("id AS seq", "timestamp_micros(id) AS ts", "id AS ts_us", "'one' AS host", "double(id) AS cpu", "id AS requests")
    rows = ranks.with_chunk(events, "ts_us", ranks.borders(events, "ts_us", 50))
    assert max(r["count"] for r in rows.groupBy("host", "_chunk").count().collect()) <= 2 * 5_000 / 50


@pytest.mark.parametrize("chunks", [2, 9, 256])
def test_folds_of_a_burst_within_one_bucket(spark, make_events, chunks):
    rows = [(10_000 + RANDOM.randrange(500), RANDOM.random(), i, "burst") for i in range(300)] + [(RANDOM.randrange(0, 60_000), RANDOM.random(), 1, "b") for _ in range(100)]
    got = rolling.rolling(make_events(rows), "20s", {"n": ("sum", "1L"), "lo": ("min", "cpu"), "hi": ("max", "cpu"), "s": ("sum", "requests")},
                          {"n": "n", "lo": "lo", "hi": "hi", "total": "s"}, chunks=chunks)
    by_seq = {r.seq: (r.n, r.lo, r.hi, r.total) for r in got.collect()}
    for i, (t, _, _, host) in enumerate(rows):
        own = [(v, q) for u, v, q, h in rows if h == host and t - 20_000 < u <= t]
        assert by_seq[i] == (len(own), min(v for v, _ in own), max(v for v, _ in own), sum(q for _, q in own))
