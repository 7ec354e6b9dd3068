"""The tick pipeline: rolling baseline and anomaly counts per host on one clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from livetick.functions.sigma import WHOLE_SUMS, beyond, whole, whole_cutoff, whole_near, whole_spread
from livetick.functions.timecols import duration_us, grid
from livetick.operators.grid import next_in_key, steps
from livetick.operators.running import ranked
from livetick.operators.sliding import deviation, moments_by, sliding_moments
from livetick.schema import DEFAULT_THRESHOLDS

_STATS = ("cpu_avg", "cpu_sd", "cpu_n", "n_current")
_SIDES = ("above", "below")


def _width(tick_us: int, base_us: int) -> int:
    if base_us % tick_us:
        raise ValueError("the baseline window must be a whole number of ticks")
    return base_us // tick_us


def last_closed(events: DataFrame, tick_us: int) -> Column:
    """Index of the last tick whose boundary an event has reached (one scalar subquery)."""
    return events.agg(F.expr(f"{grid('max(ts_us)', tick_us)} - 1 AS k")).scalar()


def tick_slices(events: DataFrame, tick: str | int, closed_only: bool = True) -> DataFrame:
    """Per host and tick: count, extremes and request statistics of the slice [T - tick, T)."""
    step = duration_us(tick)
    slices = events.selectExpr("host", f"{grid('ts_us', step)} AS k", "cpu", "requests").groupBy("host", "k").agg(
        *[F.expr(e) for e in (
            "count(cpu) AS n_current", "min(cpu) AS cpu_min", "max(cpu) AS cpu_max",
            "avg(requests) AS requests_avg", "coalesce(sum(requests), 0L) AS requests_sum",
            "count(requests) AS requests_n",
        )])
    if closed_only:
        slices = slices.filter(F.col("k") <= last_closed(events, step))
    return slices.withColumn("ts_us", F.expr(f"(k + 1) * {step}L")).drop("k")


def _baseline(events: DataFrame, step: int, width: int, closed_only: bool, ddof: int,
              filled_only: bool = False, cutoffs: dict[str, tuple[float, str]] | None = None) -> DataFrame:
    """Baselines by host and k; also ``cutoffs``, name -> (threshold, side), among the readings' whole numbers ``_x``."""
    cutoffs = cutoffs or {}
    rows = events.selectExpr("host", f"{grid('ts_us', step)} AS k", "cpu", *(["_x"] if cutoffs else []))
    sums = {c: f"CAST(coalesce({e}, 0) AS decimal(38,0)) AS {c}" for c, e in WHOLE_SUMS.items()} if cutoffs else {}
    rolled = sliding_moments(moments_by(rows, ["host", "k"], "cpu", *sums.values()), ["host"], width, filled_only, tuple(sums))
    if closed_only:
        rolled = rolled.filter(F.col("k") <= last_closed(events, step))
    if cutoffs:
        for columns in [*whole_spread(), [f"{whole_near(*c)} AS _near{name}" for name, c in cutoffs.items()]]:
            rolled = rolled.selectExpr("*", *columns)
    return rolled.selectExpr(
        "host", "k", "mean AS cpu_avg", f"{deviation('n', 'm2', ddof)} AS cpu_sd", "n AS cpu_n", "n_current",
        *[f"{whole_cutoff(*c, near=f'_near{name}')} AS {name}" for name, c in cutoffs.items()],
    )


def tick_baseline(events: DataFrame, tick: str | int, base: str | int,
                  closed_only: bool = True, ddof: int = 0) -> DataFrame:
    """Per host and tick with a non-empty window [T - base, T): avg, deviation, count, slice count."""
    step = duration_us(tick)
    return _baseline(events, step, _width(step, duration_us(base)), closed_only, ddof)


def host_ticks(
    events: DataFrame,
    tick: str | int = "200ms",
    base: str | int = "1m",
    thresholds: tuple[float, ...] = DEFAULT_THRESHOLDS,
    closed_only: bool = True,
    emit_empty: bool = False,
    ddof: int = 0,
    places: int | None = None,
) -> DataFrame:
    """One row per host and tick: the baseline and how far the tick's own samples stray from it.

    With ``places`` readings are decimal numbers of so many places, and a sample is compared with the window's exact
    mean and deviation in whole numbers; without, in doubles. Readings or sums too large for that fall back to doubles.

    Samples are never collected. Each one meets the baseline of its tick in an
    equi-join and turns into counters that are summed map-side. The baseline is
    one row per host and tick, so Spark picks broadcast or shuffle by its measured
    size; the final grouping is by boundary time, not by the join key, which
    leaves AQE free to split a tick that holds a large share of all rows.
    """
    step = duration_us(tick)
    width = _width(step, duration_us(base))
    # Said before the plan forks, so that both branches share the exchanges below.
    events = events.filter("host IS NOT NULL AND ts IS NOT NULL")
    boundary = f"(k + 1) * {step}L AS ts_us"
    levels = list(enumerate(thresholds))
    out = ["ts_us", "host", *_STATS, *[f"anomalies_{s}" for s in _SIDES]]

    exact = places is not None and ddof == 0 and min(thresholds) >= 0
    cutoffs = {f"_to_{s}{i}": (t, s) for s in _SIDES for i, t in levels} if exact else {}
    samples = events.withColumn("_x", F.expr(whole("cpu", places))) if exact else events

    def strays(side: str, i: int, threshold: float) -> str:
        near = beyond("cpu", "cpu_avg", "cpu_sd", threshold, side)
        return f"coalesce(_x {'>' if side == 'above' else '<'} _to_{side}{i}, {near})" if exact else near

    filled = _baseline(samples, step, width, closed_only, ddof, filled_only=True, cutoffs=cutoffs)
    counted = samples.selectExpr("host", f"{grid('ts_us', step)} AS k", "cpu", *(["_x"] if exact else [])).join(filled, ["host", "k"]).selectExpr(
        "host", boundary, *_STATS,
        *[f"int({strays(s, i, t)}) AS _{s}{i}" for s in _SIDES for i, t in levels],
    ).groupBy("host", "ts_us").agg(
        *[F.expr(f"max({c}) AS {c}") for c in _STATS],
        *[F.expr(f"array({', '.join(f'sum(_{s}{i})' for i, _ in levels)}) AS anomalies_{s}") for s in _SIDES],
    ).select(*out)
    # Ticks without samples of their own have nothing to count.
    zeros = f"array_repeat(0L, {len(thresholds)})"
    quiet = _baseline(events, step, width, closed_only, ddof).filter("n_current = 0").selectExpr(
        "host", boundary, *_STATS, *[f"{zeros} AS anomalies_{s}" for s in _SIDES],
    ).select(*out)
    ticks = counted.unionByName(quiet)
    return _fill_silent(ticks, step, len(thresholds)) if emit_empty else ticks


def _fill_silent(ticks: DataFrame, step: int, n_thresholds: int) -> DataFrame:
    """Also a row for each silent host and tick, between the host's first tick and the last one.

    A gap is filled from the row before it; each row looks one row ahead only.
    """
    end = ticks.agg(F.max("ts_us")).scalar()
    ahead = next_in_key(ticks.select("host", "ts_us"), ["host"], "ts_us", step * 100_000, "_next")
    zeros = f"array_repeat(0L, {n_thresholds})"
    spans = ahead.withColumn("_last", F.coalesce(F.expr(f"_next - {step}L"), end)).selectExpr(
        "host", f"ts_us div {step}L + 1 AS _low", f"_last div {step}L AS _high")
    gaps = steps(spans, "_low", "_high", "k").selectExpr(
        f"k * {step}L AS ts_us", "host",
        "CAST(NULL AS double) AS cpu_avg", "CAST(NULL AS double) AS cpu_sd", "0L AS cpu_n", "0L AS n_current",
        f"{zeros} AS anomalies_above", f"{zeros} AS anomalies_below",
    )
    return ticks.unionByName(gaps)


def slice_samples(events: DataFrame, tick: str | int, part_rows: int = 10_000) -> DataFrame:
    """The full sample list of each host and tick, in parts of ``part_rows`` samples in order of arrival.

    Part p holds the samples of ranks from ``p * part_rows`` on, so a slice of any size is kept whole without one
    array of it, and its parts are the same however the table is cut. Null readings have no rank.
    """
    step = duration_us(tick)
    rows = events.filter("host IS NOT NULL AND ts IS NOT NULL").selectExpr("host", "seq", "cpu", f"{grid('ts_us', step)} AS k")
    counts = rows.groupBy("host", "k").agg(F.count("cpu").alias("n_current"))
    placed = ranked(rows.filter("cpu IS NOT NULL"), ["host", "k"], "seq")
    parts = placed.groupBy("host", "k", F.expr(f"(rn - 1) div {part_rows} AS part")).agg(F.sort_array(F.collect_list("cpu")).alias("samples"))
    return counts.join(parts, ["host", "k"], "left").selectExpr(
        "host", f"(k + 1) * {step}L AS ts_us", "n_current", "coalesce(part, 0L) AS part", "coalesce(samples, array()) AS samples")
