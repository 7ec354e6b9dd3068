"""Order-sensitive operators: late rejection, resume merge, retention, windows on the latest event."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from livetick.functions.timecols import duration_us, grid
from livetick.operators.rollups import interval, tail
from livetick.operators.running import running
from livetick.sources.tables import latest


def late_tagged(df: DataFrame, arrival: str, newest: int | None = None, chunk_rows: int = 1_000_000) -> DataFrame:
    """Add ``late``: whether an event is older than any that arrived before it, or than ``newest``.

    ``arrival`` is a unique integer giving the order of arrival. A late event never raises the maximum, so the
    maximum over all rows is the one over accepted rows.
    """
    seen = running(
        df, [], arrival, grid(arrival, chunk_rows), {"_seen": ("max", "ts_us")}, exclusive=True,
    )
    before = "_seen" if newest is None else f"greatest(_seen, {newest}L)"
    return seen.withColumn("late", F.expr(f"coalesce(ts_us < {before}, false)")).drop("_seen")


def late_filter(df: DataFrame, arrival: str, policy: str = "drop", chunk_rows: int = 1_000_000) -> DataFrame:
    """Reject events older than any that arrived before them; equal times are accepted."""
    tagged = late_tagged(df, arrival, chunk_rows=chunk_rows)
    if policy == "drop":
        return tagged.filter("NOT late").drop("late")
    if policy == "fail":
        late = F.raise_error(F.lit("event older than the newest accepted one")).cast("boolean")
        return tagged.filter(F.when(~F.col("late"), F.lit(True)).otherwise(late)).drop("late")
    raise ValueError(f"unknown policy {policy!r}")


def resume_merge(held: DataFrame, incoming: DataFrame, id_col: str = "seq") -> DataFrame:
    """Rows already held plus a re-delivered batch, each event once.

    Older incoming rows are dropped by time; those at the newest held time are
    told apart by id, so the anti join only meets rows of that one instant.
    """
    newest_held = latest(held)
    fresh = incoming.filter(newest_held.isNull() | (F.col("ts") >= newest_held))
    at_edge = held.filter(F.col("ts") == latest(held)).select(id_col)
    return held.unionByName(fresh.join(at_edge, id_col, "left_anti"))


def retention(events: DataFrame, max_age: str | int) -> DataFrame:
    """Kept and evicted counts per host for rows with ts > max(ts) - max_age."""
    kept = F.col("ts") > latest(events) - interval(max_age)
    return events.groupBy("host").agg(
        F.count_if(kept).alias("kept"), F.count_if(~kept).alias("evicted"),
    )


def retained(events: DataFrame, max_age: str | int) -> DataFrame:
    return tail(events, max_age)


def back_window(events: DataFrame, window: str | int) -> DataFrame:
    """Events on the visible axis [t_end - window, t_end], with the axis ends."""
    w = duration_us(window)
    shown = events.filter(F.col("ts") >= latest(events) - interval(window))
    t_end = events.agg(F.max("ts_us")).scalar()
    return shown.withColumns({"t_start_us": t_end - w, "t_end_us": t_end})
