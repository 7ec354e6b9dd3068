"""Order statistics of trailing windows at every event: reducers that do not merge, such as medians.

The time of a host is cut into segments in which at most `POINTS` values enter or leave the window. What all windows of
a segment hold in common is its core. A wanted rank of a window lies, among the core's values, within as many ranks as
values come and go in the segment; so a segment needs its moving values, the core's values in those narrow bands of
ranks, and counts of the rest. Counts of values by segment and value piece say which pieces hold the bands. A piece of
one value is a count as well, and an instant at which very many values come or go is a segment of its own, which has no
moving values. Each segment is then solved by itself; its rows grow with `POINTS` and a 256th of a window's values, not
with the window, the host or an instant.

Segments do not cross the borders of eras, which are whole windows long; values of the era before are there from its
start on. So running counts are kept within a host's era, and value pieces follow values that drift. A host whose eras
all have at most `WHOLE` rows goes the same way within one task an era, which saves most of the shuffles.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from livetick.functions.timecols import duration_us, grid
from livetick.operators.ranks import CHUNKS, borders, with_chunk
from livetick.operators.running import running
from livetick.session import cut

#: Values that come or go within a segment, and value pieces of a host's era.
POINTS, PIECES = 4096, 256
#: Rows of a host's era and the one before that a single task takes; a host with more is cut into segments.
WHOLE = 1 << 20
_ERA, _SEGMENT = ["host", "era"], ["host", "era", "seg"]


def _era_length(known: DataFrame, w: int, points: int) -> int:
    """As many whole windows as hold about one segment's points; one number is read, the mean count of a host's window."""
    mean = known.groupBy("host", F.expr(grid("ts_us", w))).count().agg(F.avg("count")).first()[0]
    return w * max(1, math.ceil(points / (2 * mean))) if mean else w


def _pick(first: np.ndarray, last: np.ndarray, c: np.ndarray, places: list[np.ndarray], n_windows: int) -> list[np.ndarray]:
    """Which of the values, in ascending order, holds each wanted place of each window.

    A value counts ``c`` times in the windows with numbers from ``first`` up to ``last``. Counts of blocks of values say
    which block holds a place, and then its values are counted.
    """
    wide = math.isqrt(len(c) - 1) + 1
    n_blocks = -(-len(c) // wide)
    block = np.arange(len(c)) // wide
    change = np.zeros((n_windows + 1, n_blocks), np.int64)
    np.add.at(change, (first, block), c)
    np.add.at(change, (last, block), -c)
    upto = np.cumsum(np.cumsum(change, axis=0)[:-1], axis=1)
    fill, number, found = n_blocks * wide - len(c), np.arange(n_windows), []
    first, last, c = (np.pad(x, (0, fill)).reshape(n_blocks, wide) for x in (first, last, c))
    for place in places:
        at = (upto <= place[:, None]).sum(axis=1)
        rest = place - np.where(at > 0, upto[number, np.maximum(at - 1, 0)], 0)
        inside = (first[at] <= number[:, None]) & (number[:, None] < last[at])
        found.append(at * wide + (np.cumsum(c[at] * inside, axis=1) <= rest[:, None]).sum(axis=1))
    return found


def _era_solver(names: list[str], w: int, points: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The ranks of all windows of a host's era, from its rows: values with their time, windows asked for with their places."""
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        asked = rows[rows["n"] > 0].drop_duplicates("at").sort_values("at")
        held = rows[rows["c"] > 0].sort_values("v", kind="stable")
        t, u, c, values = asked["at"].to_numpy(), held["u"].to_numpy(), held["c"].to_numpy(), held["v"].to_numpy()
        first, last, n = np.searchsorted(t, u, "left"), np.searchsorted(t, u + w, "left"), asked["n"].to_numpy()
        wanted = [asked[f"p{i}"].to_numpy() for i in range(len(names))]
        picked = [np.zeros(len(t), np.int64) for _ in names]
        for x in range(0, len(t), points // 2):
            y = min(len(t), x + points // 2)
            met = np.flatnonzero((first < y) & (last > x))
            core = (first[met] <= x) & (last[met] >= y)
            upto = np.cumsum(np.where(core, c[met], 0))
            # Of the core, values outside the bands of ranks are counts between those that stay.
            stays, come = ~core, n[x:y] - upto[-1]
            for place in wanted:
                stays |= (upto >= (place[x:y] - come).min()) & (upto - c[met] <= place[x:y].max())
            gaps = np.bincount(np.cumsum(stays)[~stays], c[met][~stays], stays.sum() + 1).astype(np.int64)
            some = np.flatnonzero(gaps)
            kept = met[stays]
            order = np.argsort(np.concatenate([2 * np.arange(1, len(kept) + 1), 2 * some + 1]), kind="stable")
            begin = np.concatenate([np.clip(first[kept] - x, 0, y - x), np.zeros(len(some), np.int64)])[order]
            end = np.concatenate([np.clip(last[kept] - x, 0, y - x), np.full(len(some), y - x)])[order]
            weight, source = np.concatenate([c[kept], gaps[some]])[order], np.concatenate([kept, np.zeros(len(some), np.int64)])[order]
            for out, found in zip(picked, _pick(begin, end, weight, [place[x:y] for place in wanted], y - x)):
                out[x:y] = source[found]
        return pd.DataFrame({"host": asked["host"].to_numpy(), "ts_us": t, "n": n, **{name: values[at] for name, at in zip(names, picked)}})
    return solve


def _by_era(events: DataFrame, known: DataFrame, w: int, era: int, ranks: dict[str, str], value: str, points: int, shape: str) -> DataFrame:
    """The ranks of hosts whose eras are small enough for a task."""
    at, later = grid("ts_us", era), grid(f"(ts_us + {w}L)", era)
    rows = known.selectExpr("host", "v", f"""inline(array(
        struct({at} AS era, ts_us AS at, ts_us AS u, c, c AS delta, true AS asked),
        struct({later} AS era, ts_us + {w}L AS at, ts_us AS u, 0L AS c, -c AS delta, false AS asked),
        struct(if({later} <> {at}, {later}, NULL) AS era, {later} * {era}L - 1 AS at, ts_us AS u, c, c AS delta, false AS asked)))""").filter("era IS NOT NULL")
    kind = events.schema[value].dataType.simpleString()
    rows = rows.unionByName(events.filter(F.col(value).isNull()).selectExpr(
        "host", f"CAST(0 AS {kind}) AS v", f"{at} AS era", "ts_us AS at", "ts_us AS u", "0L AS c", "0L AS delta", "true AS asked"))
    rows = rows.selectExpr("*", "sum(delta) OVER (PARTITION BY host, era ORDER BY at) AS n").filter("asked OR c > 0").selectExpr(
        *_ERA, "at", "u", "v", "c", "if(asked, n, 0L) AS n", *[f"bigint(greatest(0L, least(n - 1, {rank}))) AS p{i}" for i, rank in enumerate(ranks.values())])
    return rows.groupBy(*_ERA).applyInPandas(_era_solver(list(ranks), w, points), shape)


def _times(events: DataFrame, known: DataFrame, value: str, w: int, era: int, chunks: int, points: int) -> DataFrame:
    """(host, era, at, seg, n, a, b, entered, gone): every instant at which values come or go or a window is asked for.

    ``n`` is null where none is asked for; ``a`` and ``b`` are the segment's first and last window.
    """
    at, later, first = grid("ts_us", era), grid(f"(ts_us + {w}L)", era), "CAST(NULL AS bigint)"
    comes = known.selectExpr("host", f"""inline(array(
        struct({at} AS era, ts_us AS at, c AS entered, 0L AS gone, 1L AS m, true AS asked),
        struct({later} AS era, ts_us + {w}L AS at, 0L AS entered, c AS gone, 1L AS m, false AS asked),
        struct({later} AS era, if({later} <> {at}, {later} * {era}L - 1, {first}) AS at, c AS entered, 0L AS gone, 0L AS m, false AS asked)))""")
    unknown = events.filter(F.col(value).isNull()).selectExpr("host", f"{at} AS era", "ts_us AS at", "0L AS entered", "0L AS gone", "1L AS m", "true AS asked")
    times = comes.filter("at IS NOT NULL").unionByName(unknown).groupBy(*_ERA, "at").agg(
        *[F.sum(x).alias(x) for x in ("entered", "gone", "m")], F.max("asked").alias("asked"))
    times = with_chunk(times, "at", borders(events, "ts_us", chunks), "_part")
    times = running(times, _ERA, "at", "_part", {f"_{x}": ("sum", x) for x in ("entered", "gone", "m")})
    # An instant that reaches beyond its block of points is a segment of its own.
    block, last = f"((_m - m) div {points})", f"((_m - 1) div {points})"
    times = times.selectExpr(*_ERA, "at", f"2 * {block} + if(m > 0 AND {last} > {block}, 1, 0) AS seg", "_entered AS entered", "_gone AS gone",
                             "if(asked AND _entered > _gone, _entered - _gone, NULL) AS n")
    own = "(PARTITION BY host, era, seg)"
    return times.selectExpr("*", f"min(if(n IS NULL, NULL, at)) OVER {own} AS a", f"max(if(n IS NULL, NULL, at)) OVER {own} AS b")


def _points(known: DataFrame, times: DataFrame, w: int, era: int, pieces: int) -> DataFrame:
    """(host, era, seg, kind, at, v, c, u, piece, a, b): each value as it comes and goes, or is there from the era's start.

    A piece with an odd number holds one value.
    """
    at, later = grid("ts_us", era), grid(f"(ts_us + {w}L)", era)
    members = known.selectExpr("host", "ts_us AS u", "v", "c", f"""inline(array(
        struct({at} AS era, true AS comes, {later} = {at} AS goes), struct(if({later} = {at}, NULL, {later}) AS era, false AS comes, true AS goes)))""").filter("era IS NOT NULL")
    wide = math.isqrt(pieces - 1) + 1
    cuts = members.groupBy(*_ERA).agg(F.array_distinct(F.percentile_approx("v", [i / pieces for i in range(1, pieces)], 4 * pieces)).alias("_flat"))
    cuts = cuts.select(*_ERA, "_flat", F.expr(f"transform(sequence(0, (size(_flat) - 1) div {wide}), i -> slice(_flat, i * {wide} + 1, {wide}))").alias("_nested"))
    placed = with_chunk(members.join(cuts, _ERA), "v", F.col("_nested"), "_below").selectExpr(
        *_ERA, "u", "v", "c", "comes", "goes", "2 * _below + if(coalesce(get(_flat, _below) = v, false), 1, 0) AS piece")
    moves = placed.selectExpr(*_ERA, "u", "v", "c", "piece", f"""inline(filter(array(
        if(comes, struct('comes' AS kind, u AS at), NULL), if(goes, struct('goes' AS kind, u + {w}L AS at), NULL)), x -> x IS NOT NULL))""")
    met = moves.join(times.select(*_ERA, "at", "seg", "a", "b"), [*_ERA, "at"])
    there = placed.filter("NOT comes").selectExpr(*_ERA, "u", "v", "c", "piece", "'there' AS kind", f"era * {era}L - 1 AS at",
                                                  "-1L AS seg", "CAST(NULL AS bigint) AS a", "CAST(NULL AS bigint) AS b")
    return met.unionByName(there)


def _cores(points: DataFrame, segments: DataFrame) -> DataFrame:
    """(host, era, seg, piece, a, b, v, c, near): the core's count in each value piece, and whether a band of ranks meets it."""
    count = "sum(if({}, c, 0L))"
    deltas = points.groupBy(*_SEGMENT, "piece").agg(
        F.expr(count.format("kind = 'comes' AND coalesce(at <= a, false)") + " - " + count.format("kind = 'goes' AND coalesce(at <= b AND u <= a, false)") + " AS own"),
        F.expr("sum(if(kind = 'goes', -c, c)) AS net"), F.max("v").alias("v"))
    kinds = deltas.groupBy(*_ERA, "piece").agg(F.max("v").alias("v"))
    asked = segments.filter("core > 0").join(kinds, _ERA).selectExpr(*_SEGMENT, "piece", "v", "0L AS own", "0L AS net", "a", "b", "bands")
    rows = deltas.selectExpr(*_SEGMENT, "piece", "v", "own", "net", "CAST(NULL AS bigint) AS a", "CAST(NULL AS bigint) AS b",
                             f"CAST(NULL AS {segments.schema['bands'].dataType.simpleString()}) AS bands").unionByName(asked)
    rows = rows.groupBy(*_SEGMENT, "piece").agg(*[F.max(x).alias(x) for x in ("v", "a", "b")], *[F.sum(x).alias(x) for x in ("own", "net")],
                                                F.first("bands", True).alias("bands"))
    before = "(PARTITION BY host, era, piece ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    cores = rows.selectExpr("*", f"coalesce(sum(net) OVER {before}, 0L) + own AS c").filter("a IS NOT NULL")
    cores = cores.selectExpr("*", "sum(c) OVER (PARTITION BY host, era, seg ORDER BY piece ROWS UNBOUNDED PRECEDING) AS _upto")
    return cores.filter("c > 0").selectExpr(*_SEGMENT, "piece", "a", "b", "v", "c", "piece % 2 = 0 AND exists(bands, x -> _upto - c <= x.hi AND _upto >= x.lo) AS near")


def _solver(names: list[str], w: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The ranks of one segment's windows, from its rows: windows asked for, values with their time, counts of value pieces."""
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        asked = rows[rows["kind"] == 0].sort_values("at")
        held = rows[rows["kind"] != 0].sort_values(["piece", "v"], kind="stable")
        t, c = asked["at"].to_numpy(), held["c"].to_numpy()
        always, u = (held["kind"] == 2).to_numpy(), held["at"].to_numpy()
        # The windows, by number, from which and up to which a value is held.
        first = np.where(always, 0, np.searchsorted(t, u, "left"))
        last = np.where(always, len(t), np.searchsorted(t, u + w, "left"))
        found = _pick(first, last, c, [asked[f"p{i}"].to_numpy() for i in range(len(names))], len(t))
        values = held["v"].to_numpy()
        return pd.DataFrame({"host": asked["host"].to_numpy(), "ts_us": t, "n": asked["c"].to_numpy(), **{name: values[at] for name, at in zip(names, found)}})
    return solve


def _by_segment(events: DataFrame, known: DataFrame, w: int, era: int, ranks: dict[str, str], value: str, chunks: int,
                points: int, pieces: int, shape: str) -> DataFrame:
    """The ranks of hosts of any size."""
    names, kind = list(ranks), events.schema[value].dataType.simpleString()
    times = cut(_times(events, known, value, w, era, chunks, points))
    moves = cut(_points(known, times, w, era, pieces))
    asked = times.filter("n IS NOT NULL").selectExpr(*_SEGMENT, "at", "n AS c", "entered", "gone", "a", "b", *[
        f"bigint(greatest(0L, least(n - 1, {rank}))) AS p{i}" for i, rank in enumerate(ranks.values())])
    core = "greatest(0L, min(entered) - max(gone))"
    bands = ", ".join(f"struct(min(p{i} - c) + {core} AS lo, max(p{i}) AS hi)" for i in range(len(names)))
    segments = asked.groupBy(*_SEGMENT).agg(F.min("at").alias("a"), F.max("at").alias("b"), F.expr(f"{core} AS core"), F.expr(f"array({bands}) AS bands"))
    cores = _cores(moves, segments)
    none = [f"0L AS p{i}" for i in range(len(names))]
    moving = moves.filter("at > a AND at <= b AND (kind = 'comes' OR u <= a)").selectExpr(*_SEGMENT, "1 AS kind", "u AS at", "piece", "v", "c", *none)
    held = moves.filter("kind <> 'goes' AND piece % 2 = 0").select(*_ERA, "piece", "u", "v", "c")
    near = cores.filter("near").select(*_SEGMENT, "piece", "a", "b").join(held, [*_ERA, "piece"]).filter(f"u <= a AND u + {w}L > b").selectExpr(
        *_SEGMENT, "1 AS kind", "u AS at", "piece", "v", "c", *none)
    counted = cores.filter("NOT near").selectExpr(*_SEGMENT, "2 AS kind", "0L AS at", "piece", "v", "c", *none)
    windows = asked.selectExpr(*_SEGMENT, "0 AS kind", "at", "0 AS piece", f"CAST(0 AS {kind}) AS v", "c", *[f"p{i}" for i in range(len(names))])
    rows = windows.unionByName(moving).unionByName(near).unionByName(counted)
    return rows.groupBy(*_SEGMENT).applyInPandas(_solver(names, w), shape)


def rolling_ranks(events: DataFrame, window: str | int, ranks: dict[str, str], value: str = "cpu", chunks: int = CHUNKS,
                  points: int = POINTS, pieces: int = PIECES, whole: int = WHOLE) -> DataFrame:
    """(host, ts_us, n, and each named rank) of (t - window, t] for every distinct host and instant with a known value in its window.

    A rank is SQL over ``n``, the number of known values in the window: '(n - 1) div 2' is the lower median. Two numbers
    are read: the mean count of a host's window, and how many hosts have an era of more than ``whole`` instants and values.
    """
    w = duration_us(window)
    known = events.filter(F.col(value).isNotNull()).groupBy("host", "ts_us", F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    era = _era_length(known, w, points)
    kind = events.schema[value].dataType.simpleString()
    shape = f"host {events.schema['host'].dataType.simpleString()}, ts_us bigint, n bigint, " + ", ".join(f"{name} {kind}" for name in ranks)
    # An era's task holds what falls into it and into the era before.
    large = cut(events.groupBy("host", F.expr(f"{grid('ts_us', era)} AS era")).count().filter(f"count > {whole // 2}").select("host").distinct())
    if large.isEmpty():
        return _by_era(events, known, w, era, ranks, value, points, shape)
    some, others = ([df.join(large, "host", how) for df in (events, known)] for how in ("left_semi", "left_anti"))
    return _by_segment(*some, w, era, ranks, value, chunks, points, pieces, shape).unionByName(_by_era(*others, w, era, ranks, value, points, shape))


def rolling_quantiles(events: DataFrame, window: str | int, outputs: dict[str, tuple[dict[str, str], str]], value: str = "cpu",
                      chunks: int = CHUNKS) -> DataFrame:
    """Append reducers made of ranks of (t - window, t] to every event: ``name -> (named ranks, SQL over their values)``."""
    events = events.filter("host IS NOT NULL AND ts IS NOT NULL")
    ranks = {f"_{out}_{name}": rank for out, (own, _) in outputs.items() for name, rank in own.items()}
    found = rolling_ranks(events, window, ranks, value, chunks)
    for out, (own, sql) in outputs.items():
        found = found.withColumns({name: F.col(f"_{out}_{name}") for name in own}).withColumn(f"_{out}", F.expr(sql)).drop(*own)
    found = found.select("host", "ts_us", F.col("n").alias("window_n"), *[F.col(f"_{out}").alias(out) for out in outputs])
    return events.join(found, ["host", "ts_us"], "left")


#: The mean of the two middle values.
MEDIAN = ({"lo": "(n - 1) div 2", "hi": "n div 2"}, "(lo + hi) / 2")


def floor_percentile(percent: int) -> tuple[dict[str, str], str]:
    """sorted[min(n - 1, floor(n * p / 100))]"""
    return {"at": f"n * {percent} div 100"}, "at"
