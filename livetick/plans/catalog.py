"""All registered queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from livetick.plans import chart_queries, event_queries, stream_queries, tick_queries
from livetick.session import configure

Query = Callable[[SparkSession, str], DataFrame]

TICK = [
    "host_ticks", "host_ticks_offset", "host_ticks_dense", "host_ticks_lineitem", "host_ticks_silent", "slice_samples",
    "tick_extremes", "tick_requests", "agg_frames", "tick_backfill", "last_ticks", "weighted_rollup",
    "frame_fanin", "global_ticks", "cumulative_rate", "tick_gaps", "conservation", "counter_deltas",
]
EVENT = [
    "batch_unpack", "frame_roundtrip", "snapshot_frame", "schema_contract", "required_null_quarantine",
    "enabled_hosts", "host_discovery", "high_cpu_alerts", "host_rollup", "host_tail_avg", "rolling_tail_avg",
    "event_rate", "alert_bars", "keep_topn", "first_last", "last_events", "page_summary", "custom_reducer",
    "host_apply", "series_apply", "slice_reducers", "event_baseline", "event_outliers", "event_rolling", "event_rolling_median", "ema_requests", "ema_trend", "total_req_rate",
    "back_window", "retention", "late_filter", "snapshot_append_merge", "snapshot_from_empty", "timed_points", "grid_fill", "fifo_latency",
    "fifo_residual", "latency_percentiles", "pause_rollup", "batch_stats", "egress_bytes", "phase_breakdown",
]
CHART = [
    "bands", "anomaly_dots", "anomaly_bars_15s", "anomaly_density", "anomaly_feed", "count_at_sigma",
    "count_at_sigma_log", "wide_by_ts", "axis_domain", "threshold_line", "latest_tick_per_host",
]

STREAM = [
    "stream_host_ticks", "stream_frames", "stream_resume", "stream_high_filter", "stream_retention", "stream_late", "stream_fifo",
    "stream_global_ticks", "stream_backfill", "stream_snapshot",
]


def _configured(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    groups = ((tick_queries, TICK), (event_queries, EVENT), (chart_queries, CHART), (stream_queries, STREAM))
    for module, names in groups:
        for name in names:
            found[name] = _configured(getattr(module, name))
    return found
