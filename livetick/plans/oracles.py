"""SQL twins of the registered queries, written independently of the Spark plans.

Windows are plain range joins on a tick grid, moving averages are sums over
lagged rows, late events a running maximum. Each query reads the whole tables.
"""

from __future__ import annotations

from livetick.functions.timecols import duration_us
from livetick.plans import settings as S
from livetick.plans.shape import SHIFT

_H = duration_us("1h")
_D = duration_us("1d")


def _num(expr: str, name: str | None = None) -> str:
    return f"round({expr} + {SHIFT!r}, 6) AS {name or expr}"


def _in(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


EV = """ev AS (
  SELECT event_id AS seq, ts, epoch_us(ts) AS ts_us, user_id, event_type AS host, value AS cpu,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS requests
  FROM events)"""
LI = """ev AS (
  SELECT epoch_us(l_shipdate) AS ts_us, l_returnflag AS host, l_quantity AS cpu FROM lineitem)"""
DIM = "dim(host, rank) AS (VALUES " + ", ".join(f"('{h}', {i})" for i, h in enumerate(S.HOSTS, 1)) + ")"
END = "(SELECT max(ts_us) FROM ev)"
_LEVELS = [1.0, 1.5, 2.0, 2.5, 3.0]


def _ticks(tick: str, base: str, source: str = EV) -> str:
    """CTEs ``ev`` and ``ticks``: for each boundary T the window [T - base, T) and the slice [T - tick, T)."""
    s, w = duration_us(tick), duration_us(base)
    hundredths = "CAST(round(cpu * 100) AS HUGEINT)"
    # Values have two decimals, so hundredths compare n * x - sum with t * sqrt(n * squares - sum^2) exactly.
    above, below = (", ".join(
        f"count(*) FILTER ({sign} * (b.n * e.v - b.s) > 0 AND 4 * (b.n * e.v - b.s) * (b.n * e.v - b.s) > {int(2 * t) ** 2} * (b.n * b.q - b.s * b.s))"
        for t in _LEVELS) for sign in (1, -1))
    return f"""{source},
grid AS (
  SELECT unnest(generate_series((SELECT min(ts_us) // {s} + 1 FROM ev), (SELECT max(ts_us) // {s} FROM ev))) * {s} AS t),
base AS (
  SELECT t AS ts_us, host, avg(cpu) AS cpu_avg, stddev_pop(cpu) AS cpu_sd, count(*) AS cpu_n,
    CAST(count(*) AS HUGEINT) AS n, sum({hundredths}) AS s, sum({hundredths} * {hundredths}) AS q
  FROM grid JOIN ev ON ev.ts_us >= t - {w} AND ev.ts_us < t GROUP BY ALL),
slice AS (SELECT (ts_us // {s} + 1) * {s} AS t, host, cpu, {hundredths} AS v FROM ev),
ticks AS (
  SELECT b.ts_us, b.host, b.cpu_avg, b.cpu_sd, b.cpu_n, count(e.cpu) AS n_current,
         [{above}] AS aa, [{below}] AS ab
  FROM base b LEFT JOIN slice e ON e.host = b.host AND e.t = b.ts_us
  GROUP BY b.ts_us, b.host, b.cpu_avg, b.cpu_sd, b.cpu_n, b.n, b.s, b.q)"""


TICKS = _ticks(S.TICK, S.BASE)
TICK_ROW = f"""ts_us // 1000 AS ts_ms, host, {_num('cpu_avg')}, {_num('cpu_sd')}, cpu_n, n_current,
       array_to_string(aa, ',') AS anomalies_above, array_to_string(ab, ',') AS anomalies_below"""
ENABLED = f"host NOT IN {_in(S.DISABLED)}"


def _at(counts: str, sigma: str, log: bool = False) -> str:
    """Interpolated count at sigma as an explicit CASE over the threshold intervals."""
    cases = [f"WHEN {sigma} <= 1 THEN {counts}[1]"]
    for i in range(4):
        lo, hi = f"{counts}[{i + 1}]", f"{counts}[{i + 2}]"
        part = f"(({sigma} - {_LEVELS[i]}) / 0.5)"
        line = f"{lo} + ({hi} - {lo}) * {part}"
        if log:
            # log of nothing: stay linear; nullif keeps ln() from ever seeing a zero
            curve = f"exp(ln(nullif({lo}, 0)) + (ln(nullif({hi}, 0)) - ln(nullif({lo}, 0))) * {part})"
            line = f"coalesce({curve}, {line})"
        cases.append(f"WHEN {sigma} < {_LEVELS[i + 1]} THEN {line}")
    return f"CAST(CASE {' '.join(cases)} ELSE {counts}[5] END AS DOUBLE)"


BANDS = f"""{TICKS},
vis AS (SELECT host FROM ticks GROUP BY host HAVING count(*) >= 2),
gate AS (
  SELECT *, CASE WHEN cpu_n >= {S.MIN_SAMPLES} THEN cpu_avg END AS smooth,
    CASE WHEN cpu_n >= {S.MIN_SAMPLES} THEN cpu_avg + {S.SIGMA} * cpu_sd END AS upper,
    CASE WHEN cpu_n >= {S.MIN_SAMPLES} THEN cpu_avg - {S.SIGMA} * cpu_sd END AS lower
  FROM ticks WHERE host IN (SELECT host FROM vis)),
dots AS (
  SELECT * FROM (
    SELECT ts_us, host, 'above' AS side, upper AS value, {_at('aa', str(S.SIGMA))} AS c FROM gate WHERE {ENABLED}
    UNION ALL
    SELECT ts_us, host, 'below', lower, {_at('ab', str(S.SIGMA))} FROM gate WHERE {ENABLED})
  WHERE c >= 1 AND value IS NOT NULL)"""

BASELINE = f"""{EV},
win AS (
  SELECT a.seq, a.ts_us, a.host, a.cpu, count(*) AS window_n,
    CASE WHEN count(*) >= {S.MIN_SAMPLES} THEN avg(b.cpu) END AS avg,
    CASE WHEN count(*) >= {S.MIN_SAMPLES} THEN stddev_pop(b.cpu) END AS sd
  FROM ev a JOIN ev b ON a.host = b.host AND b.ts_us > a.ts_us - {duration_us(S.BASE)} AND b.ts_us <= a.ts_us
  GROUP BY ALL),
bl AS (SELECT *, avg + 2.0 * sd AS upper, avg - 2.0 * sd AS lower FROM win)"""

# Weights below 1e-40 cannot change a double, so 400 lags give the whole average.
EMA = f"""{EV},
num AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY seq) AS pos FROM ev),
sm AS (
  SELECT a.seq, a.ts_us, a.host, a.pos,
    sum(b.requests * pow({1 - S.ALPHA_REQUESTS}, a.pos - b.pos) * CASE WHEN b.pos = 1 THEN 1.0 ELSE {S.ALPHA_REQUESTS} END) AS ema
  FROM num a JOIN num b ON a.host = b.host AND b.pos <= a.pos AND b.pos > a.pos - 400
  WHERE a.pos > {S.WARM_UP} GROUP BY ALL),
rate AS (SELECT count(*) / 86400.0 AS eps FROM ev WHERE ts_us > {END} - {_D}),
req AS (SELECT sm.*, ema * eps AS req_per_sec FROM sm, rate)"""

FIFO = f"""{EV},
ends AS (SELECT seq // {S.BATCH_ROWS} AS batch, max(ts_us) AS end_us FROM ev GROUP BY ALL),
arr AS (
  SELECT host, ts_us // {_D} AS day, seq, ts_us AS at_us,
    row_number() OVER (PARTITION BY host, ts_us // {_D} ORDER BY seq) AS rn FROM ev),
emi AS (
  SELECT host, ts_us // {_D} AS day, seq, end_us AS at_us,
    row_number() OVER (PARTITION BY host, ts_us // {_D} ORDER BY seq) AS rn
  FROM ev JOIN ends ON ends.batch = seq // {S.BATCH_ROWS} WHERE cpu <= {S.HELD_BACK}),
pairs AS (
  SELECT host, day, rn, arr.seq AS seq, emi.seq AS emit_seq, emi.at_us AS emitted_us, emi.at_us - arr.at_us AS latency_us
  FROM arr JOIN emi USING (host, day, rn))"""


def _floor_pct(rows: str, keys: str, value: str, percents: list[int]) -> str:
    picks = ", ".join(
        f"list_sort(list({value}))[least(count(*) - 1, count(*) * {p} // 100) + 1] AS p{p}" for p in percents)
    return f"SELECT {keys}, count(*) AS n, {picks} FROM {rows} GROUP BY {keys}"


def _q(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


# Every day that touches the last five days, with 0 where nothing fell.
_BARS = f"""
SELECT d.b // 1000 AS begin_ms, (d.b + {_D}) // 1000 AS end_ms, (d.b + {_D // 2}) // 1000 AS mid_ms, coalesce(n, 0) AS n
FROM (SELECT unnest(generate_series(({END} - 5 * {_D} - 1) // {_D}, {END} // {_D})) * {_D} AS b) d LEFT JOIN b ON b.b = d.b
WHERE d.b + {_D} >= {END} - {5 * _D} AND d.b <= {END}"""


def _silent() -> str:
    s = duration_us(S.TICK)
    return _q(_ticks(S.TICK, S.TICK) + f""",
firsts AS (SELECT host, min(ts_us) AS f FROM ticks GROUP BY host)""", f"""
SELECT g.t // 1000 AS ts_ms, f.host, {_num('cpu_avg')}, {_num('cpu_sd')}, coalesce(cpu_n, 0) AS cpu_n,
  coalesce(n_current, 0) AS n_current,
  coalesce(array_to_string(aa, ','), '0,0,0,0,0') AS anomalies_above,
  coalesce(array_to_string(ab, ','), '0,0,0,0,0') AS anomalies_below
FROM firsts f JOIN grid g ON g.t >= f.f AND g.t <= (SELECT max(ts_us) FROM ticks)
LEFT JOIN ticks k ON k.host = f.host AND k.ts_us = g.t""")


def oracle_sql() -> dict[str, str]:
    slices = f"{EV}, sl AS (SELECT *, (ts_us // {_H} + 1) * {_H} AS t FROM ev), cl AS (SELECT * FROM sl WHERE t <= {END})"
    raw_row = """'{"time_ms":' || (ts_us // 1000) || ',"cpu":' || cpu || ',"requests":' || requests || ',"host":"' || host || '"}'"""
    sql = {
        "host_ticks": _q(TICKS, f"SELECT {TICK_ROW} FROM ticks"),
        "host_ticks_dense": _q(_ticks(S.DENSE_TICK, S.DENSE_BASE), f"SELECT {TICK_ROW} FROM ticks"),
        "host_ticks_lineitem": _q(_ticks(S.LINE_TICK, S.LINE_BASE, LI), f"SELECT {TICK_ROW} FROM ticks"),
        "host_ticks_silent": _silent(),
        "slice_samples": _q(slices, """
SELECT t // 1000 AS ts_ms, host, CAST(rn // """ + str(S.PART_ROWS) + """ AS BIGINT) AS part, any_value(n) AS n_current,
  array_to_string(list_sort(list(cpu)), ',') AS samples
FROM (SELECT *, row_number() OVER (PARTITION BY t, host ORDER BY seq) - 1 AS rn, count(*) OVER (PARTITION BY t, host) AS n FROM sl) GROUP BY ALL""".replace(
            "GROUP BY ALL", "GROUP BY t, host, rn // " + str(S.PART_ROWS))),
        "tick_extremes": _q(slices, "SELECT t // 1000 AS ts_ms, host, min(cpu) AS cpu_min, max(cpu) AS cpu_max FROM cl GROUP BY t, host"),
        "tick_requests": _q(slices, f"""
SELECT t // 1000 AS ts_ms, host, {_num('avg(requests)', 'requests_avg')},
  CAST(sum(requests) AS BIGINT) AS requests_sum, count(requests) AS requests_n FROM cl GROUP BY t, host"""),
        "agg_frames": _q(TICKS, f"SELECT 'aggregate-append' AS type, {TICK_ROW} FROM ticks"),
        "tick_backfill": _q(TICKS, f"""
SELECT 'aggregate-snapshot' AS type, ts_us // 1000 AS ts_ms, host, {_num('cpu_avg')}, cpu_n, n_current
FROM ticks WHERE ts_us > (SELECT max(ts_us) FROM ticks) - {_D}"""),
        "last_ticks": _q(TICKS, f"""
SELECT ts_us // 1000 AS ts_ms, host, {_num('cpu_avg')}, {_num('cpu_sd')}, cpu_n, n_current
FROM ticks ORDER BY ts_us DESC, host LIMIT 20"""),
        "weighted_rollup": _q(TICKS, f"""
SELECT a.ts_us // 1000 AS ts_ms, a.host, {_num('sum(b.cpu_avg * b.cpu_n) / sum(b.cpu_n)', 'weighted_avg')},
  CAST(sum(b.cpu_n) AS BIGINT) AS weight
FROM ticks a JOIN ticks b ON a.host = b.host AND b.ts_us > a.ts_us - {6 * _H} AND b.ts_us <= a.ts_us
GROUP BY a.ts_us, a.host"""),
        "frame_fanin": _q(TICKS + ", fr AS (SELECT ts_us, sum(cpu_n) AS e FROM ticks GROUP BY ts_us)", f"""
SELECT ts_us // 1000 AS ts_ms, CAST(e AS BIGINT) AS frame_events, count(*) OVER w AS total_frames,
  CAST(sum(e) OVER w AS BIGINT) AS total_events, {_num('sum(e) OVER w / count(*) OVER w', 'fan_in')}
FROM fr WINDOW w AS (ORDER BY ts_us)"""),
        "global_ticks": _q(slices + f""",
c AS (SELECT t, count(*) AS n FROM sl GROUP BY t),
g AS (SELECT unnest(generate_series((SELECT min(t) // {_H} FROM c), {END} // {_H})) * {_H} AS t)""", f"""
SELECT g.t // 1000 AS ts_ms,
  CAST((SELECT coalesce(sum(n), 0) FROM c WHERE c.t <= g.t) AS BIGINT) AS events_ingested_total,
  {_num('coalesce(c0.n, 0) / 3600.0', 'events_per_sec')},
  CAST((SELECT coalesce(sum(n), 0) FROM c WHERE c.t <= g.t - {duration_us(S.KEEP)}) AS BIGINT) AS evicted_total
FROM g LEFT JOIN c c0 ON c0.t = g.t"""),
        "cumulative_rate": _q(slices + ", c AS (SELECT t, host, sum(requests) AS s FROM sl GROUP BY t, host)", f"""
SELECT t // 1000 AS ts_ms, host, CAST(sum(s) OVER w AS BIGINT) AS cumulative,
  {_num('s / ((t - lag(t) OVER w) / 1000000.0)', 'rate')}
FROM c WINDOW w AS (PARTITION BY host ORDER BY t)"""),
        "tick_gaps": _q(slices + f""",
d AS (SELECT DISTINCT host, t FROM cl),
gaps AS (SELECT * FROM (SELECT host, t - lag(t) OVER (PARTITION BY host ORDER BY t) AS gap FROM d) WHERE gap IS NOT NULL),
pc AS ({_floor_pct('gaps', 'host', 'gap', [50, 99])})""", f"""
SELECT pc.host, pc.n AS n_gaps, p50 // 1000 AS p50_ms, p99 // 1000 AS p99_ms,
  (SELECT count(*) FROM gaps g WHERE g.host = pc.host AND gap > {_H}) AS missed FROM pc"""),
        "conservation": _q(TICKS, f"""
SELECT count(DISTINCT ts_us) AS frames, CAST(sum(n_current) AS BIGINT) AS folded,
  (SELECT count(*) FROM ev WHERE ts_us < {END} // {_H} * {_H}) AS raw,
  {_num(f'(sum(n_current) - (SELECT count(*) FROM ev WHERE ts_us < {END} // {_H} * {_H})) * 100.0 / (SELECT count(*) FROM ev WHERE ts_us < {END} // {_H} * {_H})', 'drift_percent')},
  abs((sum(n_current) - (SELECT count(*) FROM ev WHERE ts_us < {END} // {_H} * {_H})) * 100.0 / (SELECT count(*) FROM ev WHERE ts_us < {END} // {_H} * {_H})) >= 30 AS flagged FROM ticks"""),
        "counter_deltas": _q(slices + """,
c AS (SELECT host, t, count(*) AS n, sum(requests) AS r, max(cpu) AS g FROM cl GROUP BY host, t),
e AS (SELECT host, min(t) AS t0, max(t) AS t1 FROM c GROUP BY host)""", f"""
SELECT c.host, (t1 - t0) // 1000000 AS span_sec,
  CAST(sum(n) FILTER (t > t0) AS BIGINT) AS ingested_delta, CAST(sum(r) FILTER (t > t0) AS BIGINT) AS requests_delta,
  {_num('sum(n) FILTER (t > t0) / ((t1 - t0) / 1000000.0)', 'ingested_rate')},
  {_num('sum(r) FILTER (t > t0) / ((t1 - t0) / 1000000.0)', 'requests_rate')}, max(g) AS cpu_max_peak
FROM c JOIN e USING (host) GROUP BY c.host, t0, t1"""),
        "batch_unpack": _q(EV, f"SELECT seq // {S.BATCH_ROWS} AS batch_id, ts_us // 1000 AS time_ms, cpu, requests, host FROM ev"),
        "frame_roundtrip": _q(EV, "SELECT 'append' AS type, ts_us // 1000 AS time_ms, cpu, requests, host FROM ev"),
        "snapshot_frame": _q(EV, f"""
SELECT seq // {S.BATCH_ROWS} AS part, 'snapshot' AS type, count(*) AS n_rows, min(ts_us // 1000) AS first_ms,
  max(ts_us // 1000) AS last_ms, {_num('sum(cpu)', 'cpu_sum')}
FROM ev WHERE ts_us > {END} - {duration_us(S.KEEP)} GROUP BY 1"""),
        "schema_contract": """
SELECT n AS n_rows, pos, field, kind AS declared_kind, kind AS actual_kind, spot AS actual_pos, n_null,
  spot > coalesce(lag(spot) OVER (ORDER BY pos), -1) AS in_order, n_null = 0 AND spot > coalesce(lag(spot) OVER (ORDER BY pos), -1) AS ok
FROM (SELECT *, list_position((SELECT list(column_name) FROM (DESCRIBE SELECT * FROM events)), field) - 1 AS spot FROM (SELECT count(*) AS n, count(*) FILTER (event_id IS NULL) AS a, count(*) FILTER (ts IS NULL) AS b,
  count(*) FILTER (event_type IS NULL) AS c, count(*) FILTER (value IS NULL) AS d FROM events),
LATERAL (VALUES (CAST(0 AS BIGINT), 'event_id', 'number', a), (1, 'ts', 'time', b), (2, 'event_type', 'string', c),
  (3, 'value', 'number', d)) AS v(pos, field, kind, n_null))""",
        "required_null_quarantine": _q(EV, """
SELECT seq, CASE WHEN cpu = 0 OR requests = 0 THEN 'quarantine' ELSE 'good' END AS status,
  concat_ws(',', CASE WHEN cpu = 0 THEN 'cpu' END, CASE WHEN requests = 0 THEN 'requests' END) AS missing FROM ev"""),
        "enabled_hosts": _q(EV, f"SELECT host, count(*) AS n FROM ev WHERE {ENABLED} GROUP BY host"),
        "host_discovery": _q(f"{EV}, {DIM}", "SELECT host, CAST(rank AS BIGINT) AS rank FROM dim WHERE host IN (SELECT host FROM ev)"),
        "high_cpu_alerts": _q(EV, f"SELECT host, count(*) AS alerts FROM ev WHERE {ENABLED} AND cpu > {S.HIGH} GROUP BY host"),
        "host_rollup": _q(EV, f"""
SELECT host, {_num('avg(cpu)', 'cpu_avg')}, {_num('stddev_pop(cpu)', 'cpu_sd')}, count(cpu) AS n,
  CAST(sum(requests) AS BIGINT) AS requests_sum, min(cpu) AS cpu_min, max(cpu) AS cpu_max FROM ev GROUP BY host"""),
        "host_tail_avg": _q(EV, f"""
SELECT host, {_num('avg(requests)', 'requests_avg')}, count(*) AS n FROM ev WHERE ts_us > {END} - {_D} GROUP BY host"""),
        "rolling_tail_avg": _q(EV, f"SELECT {_num('avg(cpu)', 'rolling_cpu')} FROM ev WHERE ts_us > {END} - {_D}"),
        "event_rate": _q(EV, f"SELECT count(*) AS n_events, {_num('count(*) / 86400.0', 'events_per_sec')} FROM ev WHERE ts_us > {END} - {_D}"),
        "alert_bars": _q(EV + f", b AS (SELECT ts_us // {_D} * {_D} AS b, count(*) AS n FROM ev WHERE {ENABLED} AND cpu > {S.HIGH} GROUP BY 1)", _BARS),
        "keep_topn": _q(slices, f"""
SELECT (t - {_H}) // 1000 AS ts_ms, host, CASE WHEN min(cpu) = max(cpu) THEN min(cpu) END AS cpu_keep, count(*) AS n,
  array_to_string(list_sort(list(cpu), 'DESC')[1:3], ',') AS top FROM sl GROUP BY t, host"""),
        "first_last": _q(EV + ", o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY seq) AS rn FROM ev)", """
SELECT host, min(seq) AS first_seq, arg_min(cpu, seq) AS first_cpu, max(seq) AS last_seq, arg_max(cpu, seq) AS last_cpu,
  max(seq) FILTER (rn = 6) AS at_seq, max(cpu) FILTER (rn = 6) AS at_cpu FROM o GROUP BY host"""),
        "last_events": _q(EV, "SELECT seq, ts_us // 1000 AS ts_ms, host, cpu, requests FROM ev ORDER BY ts_us DESC, seq DESC LIMIT 20"),
        "page_summary": _q(EV, f"""
SELECT count(*) FILTER (ts_us > {END} - {duration_us(S.KEEP)}) AS retained,
  count(DISTINCT host) FILTER (ts_us > {END} - {duration_us(S.KEEP)}) AS hosts,
  {_num(f'count(*) FILTER (ts_us > {END} - {_D}) / 86400.0', 'events_per_sec')},
  count(*) FILTER (ts_us <= {END} - {duration_us(S.KEEP)}) AS evicted FROM ev"""),
        "custom_reducer": _q(EV, f"SELECT host, {_num('sqrt(avg(cpu * cpu))', 'cpu_rms')} FROM ev GROUP BY host"),
        "host_apply": _q(EV, f"SELECT host, {_num('quantile_cont(cpu, 0.5)', 'median')}, {_num('max(cpu) - min(cpu)', 'spread')}, count(*) AS n FROM ev GROUP BY host"),
        "series_apply": _q(EV + f""",
p AS (SELECT *, (row_number() OVER (PARTITION BY host ORDER BY seq) - 1) // {S.SERIES_ROWS} AS part FROM ev),
d AS (SELECT *, CASE WHEN cpu < lag(cpu) OVER (PARTITION BY host, part ORDER BY seq) THEN 1 ELSE 0 END AS falls FROM p),
r AS (SELECT *, sum(falls) OVER (PARTITION BY host, part ORDER BY seq) AS run FROM d),
l AS (SELECT host, part, max(c) AS longest FROM (SELECT host, part, run, count(*) AS c FROM r GROUP BY ALL) GROUP BY host, part)""", f"""
SELECT p.host, CAST(p.part AS BIGINT) AS part, count(*) AS n, min(seq) AS first_seq, {_num('quantile_cont(cpu, 0.5)', 'median')},
  any_value(longest) AS longest_rise FROM p JOIN l ON l.host = p.host AND l.part = p.part GROUP BY p.host, p.part"""),
        "slice_reducers": _q(EV, f"""
SELECT host, ts_us // {_H} AS k, count(*) AS n, array_to_string(list_sort(list(DISTINCT requests)), ',') AS requests,
  array_to_string(list_sort(list(cpu)), ',') AS samples, array_to_string(list_sort(list(cpu), 'DESC')[1:2], ',') AS top,
  arg_min(cpu, seq) AS first_cpu, arg_max(cpu, seq) AS last_cpu, {_num('avg(cpu)', 'cpu_avg')} FROM ev GROUP BY host, ts_us // {_H}"""),
        "event_baseline": _q(BASELINE, f"""
SELECT seq, ts_us // 1000 AS ts_ms, host, cpu, window_n, {_num('avg')}, {_num('sd')}, {_num('upper')}, {_num('lower')} FROM bl"""),
        "event_outliers": _q(BASELINE, f"""
SELECT seq, ts_us // 1000 AS ts_ms, host, cpu, {_num('upper')}, {_num('lower')} FROM bl WHERE cpu > upper OR cpu < lower"""),
        "event_rolling": _q(EV, f"""
SELECT a.seq, a.ts_us // 1000 AS ts_ms, a.host, count(*) AS window_n, CAST(sum(b.requests) AS BIGINT) AS requests_sum,
  min(b.cpu) AS cpu_min, max(b.cpu) AS cpu_max, {_num('exp(avg(ln(1 + b.cpu))) - 1', 'log_mean')}
FROM ev a JOIN ev b ON a.host = b.host AND b.ts_us > a.ts_us - {duration_us(S.BASE)} AND b.ts_us <= a.ts_us
GROUP BY a.seq, a.ts_us, a.host"""),
        "event_rolling_median": _q(EV, f"""
SELECT a.seq, a.ts_us // 1000 AS ts_ms, a.host, count(*) AS window_n, {_num('quantile_cont(b.cpu, 0.5)', 'median')},
  list_sort(list(b.cpu))[least(count(*) - 1, count(*) * 90 // 100) + 1] AS p90
FROM ev a JOIN ev b ON a.host = b.host AND b.ts_us > a.ts_us - {duration_us(S.BASE)} AND b.ts_us <= a.ts_us
GROUP BY a.seq, a.ts_us, a.host"""),
        "ema_requests": _q(EMA, f"SELECT seq, ts_us // 1000 AS ts_ms, host, pos, {_num('ema')}, {_num('req_per_sec')} FROM req"),
        "ema_trend": _q(EV + ", num AS (SELECT cpu, row_number() OVER (ORDER BY seq) AS pos, count(*) OVER () AS n FROM ev)", f"""
SELECT {_num(f'sum(cpu * pow({1 - S.ALPHA_TREND}, n - pos) * CASE WHEN pos = 1 THEN 1.0 ELSE {S.ALPHA_TREND} END)', 'trend')} FROM num"""),
        "total_req_rate": _q(EMA, f"""
SELECT {_num('sum(r)', 'total_req_per_sec')} FROM (SELECT host, arg_max(req_per_sec, seq) AS r FROM req WHERE {ENABLED} GROUP BY host)"""),
        "back_window": _q(EV, f"""
SELECT seq, ts_us // 1000 AS ts_ms, host, cpu, ({END} - {5 * _D}) // 1000 AS t_start_ms, {END} // 1000 AS t_end_ms
FROM ev WHERE ts_us >= {END} - {5 * _D}"""),
        "retention": _q(EV, f"""
SELECT host, count(*) FILTER (ts_us > {END} - {duration_us(S.KEEP)}) AS kept,
  count(*) FILTER (ts_us <= {END} - {duration_us(S.KEEP)}) AS evicted FROM ev GROUP BY host"""),
        "late_filter": _q(EV + """,
a AS (SELECT *, seq * 2 + CASE WHEN cpu > """ + str(S.HIGH) + """ THEN 15 ELSE 0 END AS arrival FROM ev),
m AS (SELECT *, max(ts_us) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a)""", """
SELECT seq, ts_us // 1000 AS ts_ms, host FROM m WHERE seen IS NULL OR ts_us >= seen"""),
        "snapshot_append_merge": _q(EV, "SELECT seq, ts_us // 1000 AS ts_ms, host, cpu FROM ev"),
        "snapshot_from_empty": _q(EV, "SELECT seq, ts_us // 1000 AS ts_ms, host, cpu FROM ev"),
        "timed_points": _q(EV, f"SELECT ts_us // 1000 AS ts_ms, host, cpu FROM ev WHERE {ENABLED}"),
        "host_ticks_offset": _q(_ticks(S.TICK, S.BASE, EV.replace("value AS cpu", "value + 1000000000.0 AS cpu")), """
SELECT ts_us // 1000 AS ts_ms, host, cpu_n, n_current, array_to_string(aa, ',') AS anomalies_above,
  array_to_string(ab, ',') AS anomalies_below FROM ticks"""),
        "grid_fill": _q(EV + f""",
b AS (SELECT host, ts_us // {_H // 6} AS k, avg(cpu) AS m FROM ev GROUP BY ALL),
r AS (SELECT host, unnest(generate_series(min(k), max(k))) AS k FROM b GROUP BY host),
g AS (SELECT r.host, r.k, m, last_value(m IGNORE NULLS) OVER (PARTITION BY r.host ORDER BY r.k) AS f
      FROM r LEFT JOIN b ON b.host = r.host AND b.k = r.k)""", f"""
SELECT k * {_H // 6} // 1000 AS ts_ms, host, {_num('m', 'value')}, {_num('f', 'filled')} FROM g"""),
        "fifo_latency": _q(FIFO, "SELECT host, day, rn, seq, emit_seq, latency_us FROM pairs"),
        "fifo_residual": _q(FIFO, """
SELECT arr.host, arr.day, count(*) AS pending FROM arr LEFT JOIN emi USING (host, day, rn)
WHERE emi.seq IS NULL GROUP BY arr.host, arr.day"""),
        "latency_percentiles": _q(FIFO + """,
o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY emitted_us DESC, seq DESC) AS k FROM pairs),
ring AS (SELECT host, latency_us FROM o WHERE k <= 1024)""", _floor_pct("ring", "host", "latency_us", [50, 95, 99])),
        "pause_rollup": _q(EV, f"SELECT host, count(cpu) AS pauses, {_num('sum(cpu)', 'total_ms')}, max(cpu) AS max_ms FROM ev GROUP BY host"),
        "batch_stats": _q(EV + f", b AS (SELECT count(*) AS s FROM ev GROUP BY host, ts_us // {_H})", f"""
SELECT count(*) AS calls, CAST(sum(s) AS BIGINT) AS events, {_num('avg(s)', 'avg_batch')}, max(s) AS max_batch FROM b"""),
        "egress_bytes": _q(EV + f""",
f AS (SELECT seq // {S.BATCH_ROWS} AS b, count(DISTINCT user_id) AS subs,
        length('{{"type":"append","rows":[]}}') + sum(length({raw_row})) + count(*) - 1 AS len FROM ev GROUP BY 1)""", """
SELECT count(*) AS frames, CAST(sum(len) AS BIGINT) AS frame_chars, CAST(sum(len * subs) AS BIGINT) AS sent_chars FROM f"""),
        "phase_breakdown": f"""
WITH p AS (SELECT l_returnflag, l_extendedprice - (l_extendedprice * l_discount + l_extendedprice * l_tax) AS r FROM lineitem),
pc AS ({_floor_pct('p', 'l_returnflag', 'r', [50, 95, 99])})
SELECT l_returnflag, n, {_num('p50')}, {_num('p95')}, {_num('p99')} FROM pc""",
        "bands": _q(BANDS, f"SELECT ts_us // 1000 AS ts_ms, host, {_num('smooth')}, {_num('upper')}, {_num('lower')} FROM gate WHERE {ENABLED}"),
        "anomaly_dots": _q(BANDS, f"""
SELECT ts_us // 1000 AS ts_ms, host, side, {_num('value')}, {_num('c', 'n_at_sigma')},
  {_num('least(greatest(1.5 + 1.5 * log10(c + 1), 1.5), 8)', 'radius')}, {_num('least(0.4 + 0.15 * log10(c + 1), 0.95)', 'opacity')}
FROM dots"""),
        "anomaly_bars_15s": _q(BANDS + f", b AS (SELECT ts_us // {_D} * {_D} AS b, count(*) AS n FROM dots GROUP BY 1)", _BARS),
        "anomaly_density": _q(TICKS + f", c AS (SELECT ts_us // {_D} * {_D} AS b, host, {_at('aa', str(S.SIGMA))} + {_at('ab', str(S.SIGMA))} AS a, n_current FROM ticks)", f"""
SELECT b // 1000 AS bucket_ms, host, {_num('sum(a)', 'anomalies')}, CAST(sum(n_current) AS BIGINT) AS samples,
  {_num('CASE WHEN sum(n_current) > 0 THEN sum(a) / sum(n_current) END', 'fraction')} FROM c GROUP BY b, host"""),
        "anomaly_feed": _q(TICKS + f", c AS (SELECT ts_us, host, n_current, {_at('aa', str(S.SIGMA))} AS a, {_at('ab', str(S.SIGMA))} AS b FROM ticks)", f"""
SELECT ts_us // 1000 AS ts_ms, host, {_num('a', 'above_at_sigma')}, {_num('b', 'below_at_sigma')}, n_current
FROM c WHERE a + b > 0 ORDER BY ts_us DESC, host LIMIT 20"""),
        "wide_by_ts": _q(BANDS, "SELECT ts_us // 1000 AS ts_ms, " + ", ".join(
            _num(f"max({c}) FILTER (host = '{h}')", f"{h}_{c}") for h in S.ALL_HOSTS for c in ("smooth", "upper", "lower")
        ) + " FROM gate GROUP BY ts_us"),
        "axis_domain": _q(BANDS + f""",
e AS (SELECT min(least(smooth, upper, lower)) AS lo, max(greatest(smooth, upper, lower)) AS hi FROM gate WHERE {ENABLED}),
p AS (SELECT *, coalesce(nullif((hi - lo) * 0.1, 0), greatest(0.05, hi * 0.1)) AS pad FROM e)""", f"""
SELECT {_num('lo')}, {_num('hi')}, {_num('greatest(0, lo - pad)', 'y_min')}, {_num('hi + pad', 'y_max')} FROM p"""),
        "threshold_line": _q(BANDS, f"""
SELECT host AS series, ts_us // 1000 AS ts_ms, {_num('smooth', 'value')} FROM gate WHERE {ENABLED}
UNION ALL SELECT 'threshold', {END} // 1000 - {5 * _D // 1000}, CAST({S.HIGH} AS DOUBLE)
UNION ALL SELECT 'threshold', {END} // 1000, CAST({S.HIGH} AS DOUBLE)"""),
        "latest_tick_per_host": _q(f"{TICKS}, {DIM}, l AS (SELECT host, max(ts_us) AS ts_us FROM ticks GROUP BY host)", f"""
SELECT k.host, CAST(dim.rank AS BIGINT) AS rank, k.ts_us // 1000 AS ts_ms, printf('%.1f%%', cpu_avg * 100) AS avg_text,
  printf('%.1f%%', cpu_sd * 100) AS sd_text, cpu_n,
  CASE WHEN a < 0 THEN 'future' WHEN a < 1000 THEN a || 'ms' ELSE printf('%.1fs', a / 1000.0) END AS age
FROM (SELECT *, ({END} - ts_us) // 1000 AS a FROM ticks) k JOIN l USING (host, ts_us) LEFT JOIN dim USING (host)"""),
    }
    sql["stream_host_ticks"] = _q(TICKS, f"""
SELECT {TICK_ROW} FROM ticks WHERE ts_us <= {END} - 600000000""")  # what a 10-minute watermark has closed
    sql["stream_retention"] = sql["retention"]
    sql["stream_late"] = sql["late_filter"].replace(
        "host FROM m WHERE seen IS NULL OR ts_us >= seen", "host, coalesce(ts_us < seen, false) AS rejected FROM m")
    sql["stream_fifo"] = sql["fifo_latency"]
    sql["stream_global_ticks"] = sql["global_ticks"]
    sql["stream_backfill"] = _q(TICKS + f""",
c AS (SELECT (ts_us // {_H} + 1) * {_H} AS t, count(*) AS n FROM ev GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT min(t) // {_H} FROM c), {END} // {_H})) * {_H} AS t)""", f"""
SELECT 'host' AS kind, ts_us // 1000 AS ts_ms, host, cpu_n, n_current, array_to_string(aa, ',') AS anomalies_above,
  array_to_string(ab, ',') AS anomalies_below, CAST(NULL AS BIGINT) AS events_ingested_total
FROM ticks WHERE ts_us <= {END} - 600000000
UNION ALL
SELECT 'global', t // 1000, NULL, NULL, NULL, NULL, NULL, CAST((SELECT sum(n) FROM c WHERE c.t <= g.t) AS BIGINT)
FROM g WHERE t <= {END} - 600000000""")
    sql["stream_snapshot"] = _q(EV + ", o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts_us DESC, seq DESC) AS rn FROM ev)",
                                "SELECT host, seq, ts_us // 1000 AS ts_ms, cpu, requests FROM o WHERE rn = 1")
    sql["stream_frames"] = sql["frame_roundtrip"]
    sql["stream_resume"] = sql["snapshot_append_merge"]
    sql["stream_high_filter"] = _q(EV, f"SELECT host, count(*) AS alerts FROM ev WHERE cpu > {S.HIGH} GROUP BY host")
    sigma_rows = "(VALUES " + ", ".join(f"(CAST({s} AS DOUBLE))" for s in S.SIGMAS) + ") AS s(sigma)"
    for name, log in (("count_at_sigma", False), ("count_at_sigma_log", True)):
        sql[name] = _q(TICKS, f"""
SELECT ts_us // 1000 AS ts_ms, host, sigma, {_num(_at('aa', 'sigma', log), 'above')}, {_num(_at('ab', 'sigma', log), 'below')}
FROM ticks, {sigma_rows}""")
    return sql
