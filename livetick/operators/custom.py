"""User functions: reducers over value lists, and a function per host or sub-series.

A reducer given as three small functions runs on any group size: each task folds
its own rows, and only its folded states are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, types as T

from livetick.operators.running import ranked


def custom_reduce(
    df: DataFrame,
    key: str,
    value: str,
    partial: Callable[[pd.Series], list[float]],
    combine: Callable[[list[float], list[float]], list[float]],
    finish: Callable[[list[float]], float],
    out: str = "reduced",
) -> DataFrame:
    """Reduce ``value`` per ``key`` with a user's mergeable function.

    ``partial`` folds a batch of values to a state, ``combine`` merges two states,
    ``finish`` turns the last one into the result. A task emits one state per key and
    Arrow batch; ``combine`` must be associative. Null values are left out; a key with
    no other values has the result null.
    """
    key_type = df.schema[key].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, states = [], []
            for k, values in pdf.groupby(key, dropna=False)[value]:
                known = values.dropna()
                keys.append(None if pd.isna(k) else k)
                states.append(list(map(float, partial(known))) if len(known) else None)
            if keys:
                yield pd.DataFrame({key: pd.Series(keys, dtype=object), "_state": pd.Series(states, dtype=object)})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Fold the states of sorted keys, one batch after the other."""
        held, state, started = None, None, False

        def row() -> pd.DataFrame:
            result = None if state is None else float(finish(state))
            return pd.DataFrame({key: pd.Series([held], dtype=object), out: pd.Series([result], dtype="Float64")})

        for pdf in batches:
            done = []
            for k, more in zip(pdf[key], pdf["_state"], strict=True):
                k = None if pd.isna(k) else k
                if not started or k != held:
                    if started:
                        done.append(row())
                    held, state, started = k, None, True
                if more is not None:
                    state = list(more) if state is None else combine(state, list(more))
            if done:
                yield pd.concat(done)
        if started:
            yield row()

    folded = df.select(key, value).mapInPandas(fold, f"`{key}` {key_type}, _state array<double>")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return folded.repartition(parts, key).sortWithinPartitions(key).mapInPandas(merge, f"`{key}` {key_type}, `{out}` double")


def series_apply(df: DataFrame, key: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str,
                 rows: int = 100_000, chunk_rows: int = 1_000_000) -> DataFrame:
    """Call ``fn`` once on each sub-series of ``rows`` consecutive events of a host, in order of arrival.

    The function sees the columns of ``df`` and ``part``, the number of the sub-series, and need not be mergeable.
    Positions within a host come from chunk totals, so a call holds ``rows`` events at most, however many a host has.
    """
    placed = ranked(df, [key], "seq", chunk_rows).selectExpr(*df.columns, f"(rn - 1) div {rows} AS part")

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf.sort_values("seq").reset_index(drop=True))

    return placed.groupBy(key, "part").applyInPandas(call, schema)


def partition_apply(df: DataFrame, key: str, fn: Callable[[pd.DataFrame], pd.DataFrame],
                    schema: T.StructType | str) -> DataFrame:
    """Call ``fn`` once on all rows of each host, in arrival order.

    All rows of a host lie in one task as one pandas frame, so a host is bounded by a worker's
    memory: a few million rows. Where the function can be merged from parts, use
    `custom_reduce`, for medians `rollups.middles`, for sub-series of a stated length `series_apply`; none gathers a host.
    """
    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf.sort_values("seq").reset_index(drop=True))

    return df.groupBy(key).applyInPandas(call, schema)
