"""The tick pipeline against brute force, with gaps, ties, and one host holding most rows."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from livetick.operators.baseline import event_baseline
from livetick.operators.rolling import rolling
from livetick.operators.rollups import weighted_rollup
from livetick.operators.sliding import merge_two, moments_by, sliding_moments
from livetick.operators.ticks import host_ticks, slice_samples, tick_slices
from livetick.plans import catalog
from livetick.plans.oracles import oracle_sql


def random_events(n, seed, span_ms, hot=0.6):
    rng = random.Random(seed)
    rows = []
    for t in sorted(rng.choice([rng.randrange(span_ms), 3_333]) if rng.random() < 0.2 else rng.randrange(span_ms) for _ in range(n)):
        host = "hot" if rng.random() < hot else f"h{rng.randrange(4)}"
        rows.append((t, round(rng.gauss(50, 10), 2), rng.randrange(200), host))
    return rows


def brute_ticks(rows, tick, base, thresholds=(1, 1.5, 2, 2.5, 3)):
    last = max(r[0] for r in rows)
    out = {}
    for t in range(tick, last + 1, tick):
        for host in {r[3] for r in rows}:
            window = [r[1] for r in rows if r[3] == host and t - base <= r[0] < t]
            if not window:
                continue
            cut = [r[1] for r in rows if r[3] == host and t - tick <= r[0] < t]
            mean = sum(window) / len(window)
            sd = math.sqrt(sum((x - mean) ** 2 for x in window) / len(window))
            slack = 1e-9 * (abs(mean) + sd)
            out[t, host] = (
                mean, sd, len(window), len(cut),
                [sum(x - mean > s * sd + slack for x in cut) for s in thresholds],
                [sum(mean - x > s * sd + slack for x in cut) for s in thresholds],
            )
    return out


def as_dict(df):
    return {
        (r.ts_us // 1000, r.host): (r.cpu_avg, r.cpu_sd, r.cpu_n, r.n_current, r.anomalies_above, r.anomalies_below)
        for r in df.collect()
    }


@pytest.mark.parametrize("tick, base, seed", [(50, 400, 1), (200, 200, 2), (100, 1_500, 3)])
def test_host_ticks_brute_force(make_events, tick, base, seed):
    rows = random_events(600, seed, 10_000)
    got = as_dict(host_ticks(make_events(rows), f"{tick}ms", f"{base}ms"))
    want = brute_ticks(rows, tick, base)
    assert got.keys() == want.keys()
    for key, exp in want.items():
        assert got[key][0] == pytest.approx(exp[0]) and got[key][1] == pytest.approx(exp[1], abs=1e-6)
        assert got[key][2:] == exp[2:], key
    closed = max(r[0] for r in rows) // tick * tick
    assert sum(v[3] for v in got.values()) == sum(r[0] < closed for r in rows)
    for *_, n, above, below in got.values():
        assert all(0 <= c <= n for c in above + below)
        assert above == sorted(above, reverse=True) and below == sorted(below, reverse=True)


def test_every_frame_holds_both_hosts(make_events):
    rows = []
    for i in range(6):
        rows += [(i * 30, 0.4 + 0.1 * (i % 3), 1, "api-1"), (i * 30, 0.6 + 0.1 * (i % 3), 1, "api-2")]
    ticks = host_ticks(make_events(rows), "50ms", "1m").groupBy("ts_us").agg(F.count("*").alias("n")).collect()
    assert len(ticks) == 3 and all(r.n == 2 for r in ticks)


def test_constant_input(make_events):
    got = as_dict(host_ticks(make_events([(i * 10, 0.1, 1, "a") for i in range(40)]), "30ms", "1m"))
    assert len(got) >= 2
    for avg, sd, n, _, above, below in got.values():
        assert avg == pytest.approx(0.1) and sd == 0 and above == [0] * 5 and below == [0] * 5
    assert max(v[2] for v in got.values()) >= 5


def test_large_mean_keeps_digits(make_events):
    rows = [(i * 10, 1e9 + (i % 2), 1, "a") for i in range(100)]
    for _, sd, n, *_ in as_dict(host_ticks(make_events(rows), "100ms", "400ms")).values():
        assert sd == pytest.approx(0.5, abs=1e-3)


def test_open_tick_and_closed_only(make_events):
    events = make_events([(0, 1, 1, "a"), (120, 2, 1, "a")])
    assert sorted(k[0] for k in as_dict(host_ticks(events, "50ms", "100ms"))) == [50, 100]
    assert sorted(k[0] for k in as_dict(host_ticks(events, "50ms", "100ms", closed_only=False))) == [50, 100, 150, 200]


def test_emit_empty(make_events):
    events = make_events([(0, 1, 1, "a"), (10, 5, 1, "b"), (400, 2, 1, "a"), (460, 2, 1, "a")])
    got = as_dict(host_ticks(events, "50ms", "50ms", emit_empty=True))
    assert sorted(k[0] for k in got if k[1] == "a") == list(range(50, 451, 50))
    assert sorted(k[0] for k in got if k[1] == "b") == list(range(50, 451, 50))
    assert got[100, "a"] == (None, None, 0, 0, [0] * 5, [0] * 5)


def test_window_must_be_whole_ticks(make_events):
    with pytest.raises(ValueError):
        host_ticks(make_events([(0, 1, 1, "a")]), "50ms", "120ms")


def test_filled_only_matches_full(make_events):
    events = make_events(random_events(300, 9, 5_000))
    buckets = moments_by(events.selectExpr("host", "ts_us div 50000 AS k", "cpu"), ["host", "k"], "cpu")
    full = sliding_moments(buckets, ["host"], 7).filter("n_current > 0")
    some = sliding_moments(buckets, ["host"], 7, filled_only=True)
    key = lambda r: (r.host, r.k, r.n, round(r.mean, 9), round(r.m2, 6), r.n_current)
    assert sorted(map(key, full.collect())) == sorted(map(key, some.collect()))


def test_slice_samples_are_whole_in_parts(make_events):
    rows = random_events(500, 4, 2_000)
    got = {}
    parts = slice_samples(make_events(rows), "500ms", part_rows=7).collect()
    assert max(r.part for r in parts) > 0
    for r in parts:
        got.setdefault((r.ts_us // 1000, r.host), []).extend(r.samples)
    want = {}
    for t, cpu, _, host in rows:
        want.setdefault(((t // 500 + 1) * 500, host), []).append(cpu)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_tick_slices(make_events):
    rows = tick_slices(make_events([(0, 1, 5, "a"), (10, 3, 7, "a"), (60, 9, 1, "a")]), "50ms").collect()
    assert [(r.ts_us, r.n_current, r.cpu_min, r.cpu_max, r.requests_avg, r.requests_sum, r.requests_n) for r in rows] == [
        (50_000, 2, 1.0, 3.0, 6.0, 12, 2)]


def test_weighted_rollup_is_not_an_average_of_averages(spark):
    ticks = spark.createDataFrame([("a", 50_000, 1.0, 1), ("a", 100_000, 4.0, 3)], "host string, ts_us bigint, cpu_avg double, cpu_n bigint")
    rows = {r.ts_us: (r.weighted_avg, r.weight) for r in weighted_rollup(ticks, "50ms", "100ms").collect()}
    assert rows == {50_000: (1.0, 1), 100_000: (3.25, 4)}


@pytest.mark.parametrize("window, buckets, seed", [(1_000, 10, 5), (400, 1, 6), (600, 2, 7)])
def test_event_baseline_brute_force(make_events, window, buckets, seed):
    rows = random_events(400, seed, 5_000)
    got = {r.seq: r for r in event_baseline(make_events(rows), f"{window}ms", 2.0, 3, buckets).collect()}
    assert len(got) == len(rows)
    for i, (t, _, _, host) in enumerate(rows):
        values = [r[1] for r in rows if r[3] == host and t - window < r[0] <= t]
        assert got[i].window_n == len(values)
        if len(values) < 3:
            assert got[i].avg is None and got[i].sd is None and got[i].upper is None
            continue
        mean = sum(values) / len(values)
        sd = math.sqrt(sum((x - mean) ** 2 for x in values) / len(values))
        assert got[i].avg == pytest.approx(mean) and got[i].sd == pytest.approx(sd, abs=1e-6)
        assert got[i].upper == pytest.approx(mean + 2 * sd) and got[i].lower == pytest.approx(mean - 2 * sd)


@pytest.mark.parametrize("window, buckets, seed", [(1_000, 10, 5), (600, 2, 7), (400, 8, 11), (400, 1, 12), (500, 20, 13)])
def test_rolling_brute_force(make_events, window, buckets, seed):
    rows = random_events(400, seed, 5_000)
    folds = {"n": ("sum", "1L"), "s": ("sum", "requests"), "lo": ("min", "cpu"), "hi": ("max", "cpu")}
    outputs = {"n": "n", "mean_requests": "s / n", "spread": "hi - lo"}
    got = {r.seq: r for r in rolling(make_events(rows), f"{window}ms", folds, outputs, buckets).collect()}
    assert len(got) == len(rows)
    for i, (t, _, _, host) in enumerate(rows):
        part = [r for r in rows if r[3] == host and t - window < r[0] <= t]
        assert got[i].n == len(part)
        assert got[i].mean_requests == pytest.approx(sum(r[2] for r in part) / len(part))
        assert got[i].spread == pytest.approx(max(r[1] for r in part) - min(r[1] for r in part))


def test_windows_that_do_not_divide_are_refused(make_events):
    events = make_events([(1, 1, 1, "a")])
    for buckets in (7, 0):
        with pytest.raises(ValueError, match="must divide"):
            event_baseline(events, "1s", 2.0, buckets=buckets)


def test_results_do_not_depend_on_the_buckets(make_events):
    burst = make_events([(1_000 + i // 50, (i * 7) % 13, 1, "hot") for i in range(500)] + [(i * 37, 1 + i % 3, 2, "calm") for i in range(100)])
    several = [sorted((r.seq, r.window_n, round(r.avg, 9), round(r.sd, 9)) for r in event_baseline(burst, "1s", 2.0, buckets=b).collect())
               for b in (1, 4, 20, 1000)]
    assert all(x == several[0] for x in several)


def test_counts_beyond_32_bits_squared(spark):
    """Windows of many billions of samples stay within range."""
    n = 50_000_000_000
    buckets = spark.createDataFrame([("a", 0, n, 1.0, 0.0), ("a", 1, n, 3.0, 0.0), ("a", 2, n, 3.0, 0.0)],
                                    "host string, k bigint, n bigint, mean double, m2 double")
    rows = {r.k: (r.n, r.mean, r.m2 / r.n) for r in sliding_moments(buckets, ["host"], 2).collect()}
    assert rows[1] == (2 * n, 2.0, 1.0) and rows[2] == (2 * n, 3.0, 0.0)
    both = merge_two(buckets.filter("k < 2"), ["host"]).first()
    assert (both.n, both.mean, both.m2 / both.n) == (2 * n, 2.0, 1.0)


@pytest.mark.parametrize("offset", [0, 10**9])
def test_counts_of_decimal_readings_are_exact(make_events, offset):
    """A reading that differs from its cutoff by less than the doubles around it, and one on its cutoff."""
    values = [0, 0, 1, 2] * 200 + [1]
    rows = [(i // 100, offset + v / 100, 0, "a") for i, v in enumerate(values)]
    rows += [(10, offset + v / 100, 0, "tie") for v in (7, 9)] + [(10, offset + 0.1, 0, "one")] * 333
    many = [0] * 5_000 + [1] * 4_999  # half of them lie 0.0000005 beyond one deviation
    rows += [(10, offset + v / 100, 0, "close") for v in many]
    got = {r.host: (r.anomalies_above, r.anomalies_below) for r in
           host_ticks(make_events(rows + [(50, offset, 0, "end")]), "50ms", "100ms", places=2).collect()}

    def exact(own):
        n, s, q = len(own), sum(own), sum(v * v for v in own)
        return tuple([sum(1 for v in own if sign * (n * v - s) > 0 and 4 * (n * v - s) ** 2 > t * t * (n * q - s * s)) for t in (2, 3, 4, 5, 6)] for sign in (1, -1))

    assert got["a"] == exact(values)
    assert got["close"] == exact(many) and got["close"][0][0] == 4_999
    assert got["tie"] == ([0] * 5, [0] * 5) and got["one"] == ([0] * 5, [0] * 5)


def test_offset_query_counts_what_its_twin_counts(spark, tmp_path):
    """4,999 readings a billion high that lie 0.0000005 beyond one deviation."""
    events = spark.range(10_000).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:10:00' + if(id = 9999, interval 2 hours, interval 0 hours) AS ts", "1L AS user_id",
        "'view' AS event_type", "if(id < 5000, 0D, 0.01D) AS value", "'{\"k\": 1}' AS props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(oracle_sql()["host_ticks_offset"])
    got = catalog.queries()["host_ticks_offset"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    assert "4999,0,0,0,0" in {r.anomalies_above for r in got}


def test_readings_without_a_whole_number_fall_back(make_events):
    rows = [(i, 1e20 if i == 3 else i % 2, 0, "a") for i in range(40)] + [(60, 0, 0, "a")]
    exact, plain = (as_dict(host_ticks(make_events(rows), "50ms", "100ms", places=p)) for p in (2, None))
    assert exact == plain and exact[50, "a"][4][0] == 1
