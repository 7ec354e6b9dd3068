"""Running totals that never put one key in one task.

A plain ``OVER (PARTITION BY key)`` sorts a whole key in one task, so a key with
a third of all rows decides the run time. Here each key is cut into chunks along
its order. A chunk is scanned on its own, and what came before it is added from
a table with one row per key and chunk. A chunk of width w over a unique integer
order column holds at most w rows, whatever the skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from livetick.functions.timecols import grid


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    chunk: str,
    measures: dict[str, tuple[str, str]],
    descending: bool = False,
    exclusive: bool = False,
) -> DataFrame:
    """Add running folds per key along the unique column ``order``.

    ``measures`` maps an output name to ('sum' | 'max' | 'min', SQL expression).
    ``chunk`` is an expression that does not decrease along ``order``.
    ``exclusive`` leaves the row's own value out; a sum then starts at 0, a max or
    min at null. Keys and order are required columns, checked at the source.
    """
    way = "DESC" if descending else "ASC"
    end = "1 PRECEDING" if exclusive else "CURRENT ROW"
    by_key = f"PARTITION BY {', '.join(keys)} " if keys else ""
    by_chunk = ", ".join([*keys, "_chunk"])
    within = f"(PARTITION BY {by_chunk} ORDER BY {order} {way} ROWS BETWEEN UNBOUNDED PRECEDING AND {end})"
    before = f"({by_key}ORDER BY _chunk {way} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

    rows = df.selectExpr("*", f"{chunk} AS _chunk", *[f"{e} AS _v_{n}" for n, (_, e) in measures.items()])
    totals = rows.groupBy(*keys, "_chunk").agg(
        *[F.expr(f"{fn}(_v_{n}) AS _t_{n}") for n, (fn, _) in measures.items()]
    )
    carry = totals.selectExpr(
        *keys, "_chunk", *[f"{fn}(_t_{n}) OVER {before} AS _c_{n}" for n, (fn, _) in measures.items()],
    )
    local = rows.selectExpr("*", *[f"{fn}(_v_{n}) OVER {within} AS _l_{n}" for n, (fn, _) in measures.items()])
    merged = {
        "sum": "coalesce(_l_{n}, 0) + coalesce(_c_{n}, 0)", "max": "greatest(_l_{n}, _c_{n})",
        "min": "least(_l_{n}, _c_{n})",
    }
    # The scanned rows already lie by (key, chunk), so only the carry table moves.
    return local.join(carry, [*keys, "_chunk"]).selectExpr(
        *df.columns, *[f"{merged[fn].format(n=n)} AS {n}" for n, (fn, _) in measures.items()]
    )


def ranked(df: DataFrame, keys: list[str], seq: str, chunk_rows: int = 1_000_000,
           name: str = "rn", descending: bool = False) -> DataFrame:
    """1-based position of each row within its key, along the unique id ``seq``."""
    return running(df, keys, seq, grid(seq, chunk_rows), {name: ("sum", "1L")}, descending=descending)
