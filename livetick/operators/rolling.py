"""Trailing folds at every event, for any reducer made of sums, minima and maxima.

A reducer is a set of folds, ``name -> ('sum' | 'min' | 'max', SQL over a row)``,
and SQL over the folded values; a geometric mean is ``exp(s / n)`` over
``s = sum(ln(x))`` and ``n = sum(1)``. Windows are built as for the baselines:
nothing is subtracted, so minima and maxima roll as sums do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from livetick.functions.timecols import duration_us, grid, grid_start
from livetick.operators.baseline import BUCKETS, bucket_step
from livetick.operators.ranks import CHUNKS, borders, with_chunk

Folds = dict[str, tuple[str, str]]


def _merge(fn: str, a: str, b: str) -> str:
    """Two folded values as one; null stands for an empty part."""
    if fn == "sum":
        return f"coalesce({a} + {b}, {a}, {b})"
    return f"{'least' if fn == 'min' else 'greatest'}({a}, {b})"


def sliding_folds(buckets: DataFrame, keys: list[str], width: int, folds: dict[str, str]) -> DataFrame:
    """Folds of the ``width`` buckets ending at each k, for every k with a non-empty window.

    ``buckets`` has one column per fold. Heads and tails of blocks of ``width``
    buckets are merged, as in ``sliding_moments``.
    """
    group = "PARTITION BY " + ", ".join([*keys, "_start"])
    near, upto = f"({group} ORDER BY k)", f"({group} ORDER BY k ROWS UNBOUNDED PRECEDING)"
    since = f"({group} ORDER BY k DESC ROWS UNBOUNDED PRECEDING)"
    shape = "struct<" + ", ".join(f"{m}: {buckets.schema[m].dataType.simpleString()}" for m in folds) + ">"

    def values(p: str) -> str:
        return "struct(" + ", ".join(f"{p}{m} AS {m}" for m in folds) + ")"

    rows = (
        buckets.selectExpr(*keys, "k", *folds, f"{grid_start('k', width)} AS _start")
        .selectExpr(
            "*", f"lead(k) OVER {near} AS _next", f"lag(k) OVER {near} AS _prev",
            *[f"{fn}({m}) OVER {upto} AS _f{m}" for m, fn in folds.items()],
        ).selectExpr("*", *[f"{fn}({m}) OVER {since} AS _b{m}" for m, fn in folds.items()])
    )
    unset, none = f"CAST(NULL AS {shape})", f"CAST(struct({', '.join(['NULL'] * len(folds))}) AS {shape})"
    later, tail_from = f"_start + {width}L AS block", f"coalesce(_prev + 1, _start + 1) + {width - 1}L"
    changes = rows.selectExpr(*keys, f"""inline(array(
        struct(_start AS block, k AS p, {values('_f')} AS head, {unset} AS tail),
        struct({later}, if(k > _start, {tail_from}, NULL) AS p, {unset} AS head, {values('_b')} AS tail),
        struct({later}, if(_next IS NULL, k + {width}L, NULL) AS p, {unset} AS head, {none} AS tail)))""",
    ).filter("p IS NOT NULL")
    at = "PARTITION BY " + ", ".join([*keys, "block"]) + " ORDER BY p"
    peers = f"({at} RANGE UNBOUNDED PRECEDING)"
    some = " OR ".join(f"{m} IS NOT NULL" for m in folds)
    return changes.selectExpr(
        *keys, "p", f"coalesce(lead(p) OVER ({at}) - 1, block + {width - 1}L) AS _last",
        f"last(head, true) OVER {peers} AS h", f"last(tail, true) OVER {peers} AS t",
    ).selectExpr(
        *keys, "p", "_last", *[f"{_merge(fn, f'h.{m}', f't.{m}')} AS {m}" for m, fn in folds.items()],
    ).filter(f"p <= _last AND ({some})").selectExpr(*keys, "explode(sequence(p, _last)) AS k", *folds)


def trailing_folds(events: DataFrame, window: str | int, folds: Folds, buckets: int = BUCKETS, chunks: int = CHUNKS) -> DataFrame:
    """Folds of (t - window, t] for every distinct (host, ts_us)."""
    w = duration_us(window)
    step = bucket_step(w, buckets)
    kinds = {m: fn for m, (fn, _) in folds.items()}
    aggregates = [F.expr(f"{fn}({e}) AS {m}") for m, (fn, e) in folds.items()]
    instants = events.groupBy("host", "ts_us").agg(*aggregates)
    rows = instants.selectExpr("host", f"""inline(array(
        struct(ts_us, false AS probe, {', '.join(folds)}),
        struct(ts_us - {w}L AS ts_us, true AS probe, {', '.join(f'NULL AS {m}' for m in folds)})))""",
    ).selectExpr("*", f"{grid('ts_us', step)} AS k")
    rows = with_chunk(rows, "ts_us", borders(events, "ts_us", chunks))
    group = "PARTITION BY host, k, _chunk"
    upto = f"({group} ORDER BY ts_us, probe ROWS UNBOUNDED PRECEDING)"
    # Read backwards, a probe comes before data of its own instant, which lies outside the window.
    after = f"({group} ORDER BY ts_us DESC, probe DESC ROWS UNBOUNDED PRECEDING)"
    local = rows.selectExpr(
        "*", f"lead(1) OVER ({group} ORDER BY ts_us, probe) AS _next", *[f"{fn}({m}) OVER {upto} AS _u{m}" for m, fn in kinds.items()],
    ).selectExpr("*", *[f"{fn}({m}) OVER {after} AS _a{m}" for m, fn in kinds.items()])
    # What the bucket's other chunks hold, before a row's own and behind it.
    before, behind = (f"(PARTITION BY host, k ORDER BY _chunk {way} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)" for way in ("ASC", "DESC"))
    carry = local.filter("_next IS NULL").selectExpr(
        "host", "k", "_chunk", *[f"{fn}(_u{m}) OVER {before} AS _cu{m}" for m, fn in kinds.items()],
        *[f"{fn}(_u{m}) OVER {behind} AS _ca{m}" for m, fn in kinds.items()])
    ends = local.join(carry, ["host", "k", "_chunk"]).selectExpr(
        "host", "k", "probe", f"if(probe, ts_us + {w}L, ts_us) AS ts_us",
        *[f"if(probe, {_merge(fn, f'_a{m}', f'_ca{m}')}, {_merge(fn, f'_u{m}', f'_cu{m}')}) AS {m}" for m, fn in kinds.items()],
    )
    if buckets == 1:
        return ends.groupBy("host", "ts_us").agg(*[F.expr(f"{fn}({m}) AS {m}") for m, fn in kinds.items()])
    totals = events.groupBy("host", F.expr(f"{grid('ts_us', step)} AS k")).agg(*aggregates)
    between = sliding_folds(totals, ["host"], buckets - 1, kinds).selectExpr(
        "host", "k + 1 AS k", *[f"{m} AS _w{m}" for m in folds],
    )
    parts = ends.join(between, ["host", "k"], "left").selectExpr(
        "host", "ts_us", *[f"if(probe, {m}, {_merge(fn, m, f'_w{m}')}) AS {m}" for m, fn in kinds.items()],
    )
    return parts.groupBy("host", "ts_us").agg(*[F.expr(f"{fn}({m}) AS {m}") for m, fn in kinds.items()])


def rolling(events: DataFrame, window: str | int, folds: Folds, outputs: dict[str, str],
            buckets: int = BUCKETS, chunks: int = CHUNKS) -> DataFrame:
    """Append reducers of (t - window, t] of the event's host to every event."""
    events = events.filter("host IS NOT NULL AND ts IS NOT NULL")
    named = {f"_r_{m}": fold for m, fold in folds.items()}
    stats = trailing_folds(events, window, named, buckets, chunks).selectExpr("host", "ts_us", *[f"_r_{m} AS {m}" for m in folds])
    reduced = stats.selectExpr("host", "ts_us", *[f"{e} AS {name}" for name, e in outputs.items()])
    return events.join(reduced, ["host", "ts_us"])
