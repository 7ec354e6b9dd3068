"""Trailing statistics at every event: the window (t - w, t] of its host.

The window is cut at bucket borders into three parts: the end of its oldest
bucket, whole buckets between, and the start of the event's own bucket. Whole
buckets come from the sliding tick table. The two ends are running passes over
the distinct instants of a (host, bucket), which are cut into chunks of time with
about equal shares of all instants; what the chunks before (or behind) hold is
added from a table of chunk totals. So neither a busy host, nor a burst within
one bucket, nor many events at one instant gather in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from livetick.functions.timecols import duration_us, grid
from livetick.operators.ranks import CHUNKS, borders, with_chunk
from livetick.operators.sliding import deviation, merge_two, moments_by, sliding_moments


#: Buckets a window is cut into. A task holds the buckets of one window, and about one in `CHUNKS` of all distinct
#: instants of one host and bucket.
BUCKETS = 20


def bucket_step(window: str | int, buckets: int) -> int:
    """The bucket width in microseconds; a window that does not divide is refused."""
    w = duration_us(window)
    if buckets < 1 or w % buckets:
        raise ValueError("the window must divide into the buckets")
    return w // buckets


def _joined(a: str, b: str) -> list[str]:
    """Moments a and b of separate values as one; a count of 0 or null stands for none."""
    na, nb = f"coalesce({a}n, 0L)", f"coalesce({b}n, 0L)"
    mean_a, mean_b = f"coalesce({a}mean, {b}mean)", f"coalesce({b}mean, {a}mean)"
    return [
        f"{na} + {nb} AS n", f"{mean_a} + ({mean_b} - {mean_a}) * {nb} / nullif({na} + {nb}, 0L) AS mean",
        f"coalesce({a}m2, 0D) + coalesce({b}m2, 0D) + ({mean_b} - {mean_a}) * ({mean_b} - {mean_a}) * {na} * {nb} / nullif({na} + {nb}, 0L) AS m2",
    ]


def _both_ways(rows: DataFrame, group: str, upwards: str, downwards: str, frame: str) -> DataFrame:
    """Running moments in either direction (_un, _umean, _um2 and _an, ...), and the next ``ts_us`` upwards.

    Sums are taken around the group's first mean, so large means lose no digits.
    """
    def moments(p: str, order: str) -> tuple[list[str], list[str]]:
        over = f"OVER ({group} ORDER BY {order} {frame})"
        sums = [f"sum(n) {over} AS {p}n", f"sum(n * (mean - _c)) {over} AS {p}1", f"sum(m2 + n * (mean - _c) * (mean - _c)) {over} AS {p}2"]
        return sums, [f"{p}n", f"_c + {p}1 / {p}n AS {p}mean", f"greatest(0D, {p}2 - {p}1 * {p}1 / {p}n) AS {p}m2"]

    (up, up_out), (down, down_out) = moments("_u", upwards), moments("_a", downwards)
    whole = f"({group} ORDER BY {upwards} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return rows.selectExpr("*", f"first(mean) IGNORE NULLS OVER {whole} AS _c", f"lead(1) OVER ({group} ORDER BY {upwards}) AS _next").selectExpr(
        "*", *up).selectExpr("*", *down).selectExpr(*rows.columns, "_next", *up_out, *down_out)


def _window_ends(events: DataFrame, w: int, step: int, chunks: int) -> DataFrame:
    """The part of each window in the event's own bucket, and the part in the bucket one window back (``probe``)."""
    instants = moments_by(events, ["host", "ts_us"], "cpu")
    # Each instant adds its values to its own bucket and asks the bucket one window back
    # for what came after t - w there; a probe carries no values.
    rows = instants.selectExpr(
        "host", "inline(array("
        "named_struct('ts_us', ts_us, 'n', n, 'mean', mean, 'm2', m2), "
        f"named_struct('ts_us', ts_us - {w}L, 'n', NULL, 'mean', NULL, 'm2', NULL)))",
    ).selectExpr("*", f"{grid('ts_us', step)} AS k")
    rows = with_chunk(rows, "ts_us", borders(events, "ts_us", chunks))

    # Within a chunk, around a value of its own. Read backwards, a probe comes before data of its own instant,
    # which lies outside the window.
    local = _both_ways(rows, "PARTITION BY host, k, _chunk", "ts_us, n NULLS LAST", "ts_us DESC, n DESC NULLS FIRST", "ROWS UNBOUNDED PRECEDING")
    last = local.filter("_next IS NULL").selectExpr("host", "k", "_chunk", "_un AS n", "_umean AS mean", "_um2 AS m2", "CAST(NULL AS bigint) AS ts_us")
    carry = _both_ways(last, "PARTITION BY host, k", "_chunk", "_chunk DESC", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    carry = carry.selectExpr("host", "k", "_chunk", *[f"_{s}{m} AS _c{s}{m}" for s in "ua" for m in ("n", "mean", "m2")])
    return local.join(carry, ["host", "k", "_chunk"]).selectExpr(
        "host", "k", "n IS NULL AS probe", f"if(n IS NULL, ts_us + {w}L, ts_us) AS ts_us",
        *[f"if(n IS NULL, _a{m}, _u{m}) AS _x{m}" for m in ("n", "mean", "m2")], *[f"if(n IS NULL, _ca{m}, _cu{m}) AS _y{m}" for m in ("n", "mean", "m2")],
    ).selectExpr("host", "k", "probe", "ts_us", *_joined("_x", "_y")).filter("n > 0")


def trailing_moments(events: DataFrame, window: str | int, buckets: int = BUCKETS, chunks: int = CHUNKS) -> DataFrame:
    """n, mean, m2 of (t - window, t] for every distinct (host, ts_us)."""
    w = duration_us(window)
    step = bucket_step(w, buckets)
    ends = _window_ends(events, w, step, chunks)
    if buckets == 1:
        return merge_two(ends.drop("k", "probe"), ["host", "ts_us"])
    totals = moments_by(events.selectExpr("host", f"{grid('ts_us', step)} AS k", "cpu"), ["host", "k"], "cpu")
    # What lies between is added to the part that starts the event's own bucket.
    between = sliding_moments(totals, ["host"], buckets - 1).selectExpr(
        "host", "k + 1 AS k", "n AS bn", "mean AS bmean", "m2 AS bm2",
    )
    # Joined on what the windows already partition by; probes take nothing from it.
    parts = ends.join(between, ["host", "k"], "left").selectExpr(
        "host", "ts_us", "n", "mean", "m2", "if(probe, 0L, coalesce(bn, 0L)) AS bn",
        "coalesce(bmean, mean) - mean AS gap", "coalesce(bm2, 0D) AS bm2",
    ).selectExpr(
        "host", "ts_us", "n + bn AS n", "mean + gap * bn / (n + bn) AS mean",
        "if(bn = 0, m2, m2 + bm2 + gap * gap * n * bn / (n + bn)) AS m2",
    )
    return merge_two(parts, ["host", "ts_us"])


def event_baseline(events: DataFrame, window: str | int, sigma: float, min_samples: int = 0,
                   buckets: int = BUCKETS, ddof: int = 0, chunks: int = CHUNKS) -> DataFrame:
    """Append avg, sd, upper, lower (and the window count) to every event; null below ``min_samples``."""
    events = events.filter("host IS NOT NULL AND ts IS NOT NULL")
    stats = trailing_moments(events, window, buckets, chunks).selectExpr(
        "host", "ts_us", "n AS window_n", f"if(n >= {min_samples}, mean, NULL) AS avg",
        f"if(n >= {min_samples}, {deviation('n', 'm2', ddof)}, NULL) AS sd",
    )
    return events.join(stats, ["host", "ts_us"]).selectExpr(
        "*", f"avg + {sigma!r}D * sd AS upper", f"avg - {sigma!r}D * sd AS lower",
    )


def outliers(rows: DataFrame) -> DataFrame:
    """Events outside their own band."""
    return rows.filter("cpu > upper OR cpu < lower")
