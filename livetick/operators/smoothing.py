"""Exponential moving averages as a distributed scan.

One step is the map s -> (1 - a) s + a x. Maps of that kind compose to maps of that kind, so rows are folded in blocks,
the folds of blocks are scanned in the same way, and so on; no value is left out, however old.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from livetick.operators.running import ranked

#: Rows of one block at most, and the smallest factor over a block, so that values scaled by their age stay finite.
BLOCK_ROWS, _SMALLEST = 10_000, 1e-150


def affine_scan(steps: DataFrame, keys: list[str], at: str, added: str, factor: float, out: str) -> DataFrame:
    """State after each step of s -> factor * s + added, from 0 on; ``at`` numbers the steps of a key from 0 without gaps.

    Inside a block the state is a running sum of the added values scaled up by their age. What came before a block is
    the state at the end of the one before it, which is a scan over the blocks with the factor of a whole block. The
    factor shrinks with every level until its square is no number but 0; then one step back is all there is.
    """
    if factor * factor == 0.0:
        before = steps.selectExpr(*[f"{k} AS _k{i}" for i, k in enumerate(keys)], f"{at} + 1 AS _at", f"{added} AS _before")
        met = steps.join(before, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col(at) == F.col("_at")], "left")
        return met.selectExpr(*steps.columns, f"{added} + {factor!r}D * coalesce(_before, 0D) AS {out}")
    block = BLOCK_ROWS if factor == 1.0 else max(2, min(BLOCK_ROWS, int(math.log(_SMALLEST) / math.log(factor))))
    group = ", ".join([*keys, "_block"])
    local = steps.selectExpr("*", f"{at} div {block} AS _block", f"{at} % {block} AS _off").selectExpr(
        "*", f"pow({factor!r}D, _off) * sum({added} * pow({factor!r}D, -_off)) OVER (PARTITION BY {group} ORDER BY {at} ROWS UNBOUNDED PRECEDING) AS _local")
    # Only whole blocks have one after them.
    folded = local.filter(f"_off = {block - 1}").selectExpr(*keys, "_block AS _step", "_local AS _fold")
    states = affine_scan(folded, keys, "_step", "_fold", factor**block, "_state").selectExpr(
        *[f"{k} AS _k{i}" for i, k in enumerate(keys)], "_step + 1 AS _next", "_state")
    met = local.join(states, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_block") == F.col("_next")], "left")
    return met.selectExpr(*steps.columns, f"_local + coalesce(pow({factor!r}D, _off + 1) * _state, 0D) AS {out}")


def ema(df: DataFrame, keys: list[str], value: str, alpha: float, out: str = "ema",
        chunk_rows: int = 1_000_000) -> DataFrame:
    """EMA per key in ``seq`` order, seeded with the first value; also ``pos``, the 1-based position."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    placed = ranked(df.filter(f"{value} IS NOT NULL"), keys, "seq", chunk_rows, name="pos").selectExpr(
        "*", "pos - 1 AS _at", f"if(pos = 1, double({value}), {alpha!r}D * {value}) AS _added")
    return affine_scan(placed, keys, "_at", "_added", 1.0 - alpha, out).select(*df.columns, out, "pos")


def ema_last(df: DataFrame, value: str, alpha: float, chunk_rows: int = 1_000_000) -> DataFrame:
    """The final EMA over all hosts in arrival order: every value weighted by its age, the first one not by alpha."""
    keep = f"{1.0 - alpha!r}D"
    rows = df.filter(f"{value} IS NOT NULL").selectExpr("seq", f"double({value}) AS x")
    aged = ranked(rows, [], "seq", chunk_rows, name="_age", descending=True).selectExpr("seq", "x", f"x * pow({keep}, _age - 1) AS _term")
    # The first value keeps the share that all steps after it leave.
    return aged.agg(F.expr(f"{alpha!r}D * sum(_term) + {keep} * min_by(_term, seq) AS trend"))


def after_warm_up(smoothed: DataFrame, skip: int) -> DataFrame:
    """Drop the first ``skip`` smoothed rows of each key."""
    return smoothed.filter(F.col("pos") > skip)


def scaled(smoothed: DataFrame, column: str, factor: Column, out: str) -> DataFrame:
    """Scale a column by a scalar such as the measured event rate; nulls are dropped."""
    return smoothed.filter(F.col(column).isNotNull()).withColumn(out, F.col(column) * factor)
