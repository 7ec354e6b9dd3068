"""Neighbours along a key and alignment to a step grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from livetick.functions.timecols import duration_us, grid
from livetick.operators.running import running


def next_in_key(df: DataFrame, keys: list[str], order: str, chunk: int, name: str) -> DataFrame:
    """The following value of a unique order column within its key, null at the end."""
    return running(df, keys, order, grid(order, chunk), {name: ("min", order)}, descending=True, exclusive=True)


def previous_in_key(df: DataFrame, keys: list[str], order: str, chunk: int, name: str) -> DataFrame:
    """The preceding value of a unique order column within its key, null at the start."""
    return running(df, keys, order, grid(order, chunk), {name: ("max", order)}, exclusive=True)


def steps(spans: DataFrame, low: str, high: str, name: str, block: int = 10_000) -> DataFrame:
    """One row per whole step from ``low`` to ``high`` of each row, both ends included.

    Blocks of steps first, dealt over the tasks, then the steps of a block, so that a long
    span is neither one array nor one task. A span without steps gives no rows.
    """
    keep = [c for c in spans.columns if c not in (low, high)]
    blocks = spans.filter(F.expr(f"{low} <= {high}")).selectExpr(
        *keep, low, high, f"explode(sequence({grid(low, block)}, {grid(high, block)})) AS _block")
    return blocks.repartition(*keep, "_block").selectExpr(
        *keep, f"explode(sequence(greatest({low}, _block * {block}L), least({high}, _block * {block}L + {block - 1}L))) AS {name}")


def grid_fill(events: DataFrame, step: str | int, chunk_steps: int = 100_000) -> DataFrame:
    """Step means per host on a dense grid from its first to its last step.

    ``value`` is null in an empty cell; ``filled`` carries the last known value
    forward. Each bucket fills the gap up to the next one, block by block of a long gap.
    """
    width = duration_us(step)
    buckets = events.groupBy("host", F.expr(f"{grid('ts_us', width)} AS k")).agg(F.avg("cpu").alias("mean"))
    ahead = next_in_key(buckets, ["host"], "k", chunk_steps, "_next")
    spans = ahead.selectExpr("host", "k AS _k", "mean", "k AS _low", "coalesce(_next - 1, k) AS _high")
    cells = steps(spans, "_low", "_high", "k")
    return cells.selectExpr(f"k * {width}L AS ts_us", "host", "if(k = _k, mean, NULL) AS value", "mean AS filled")
