"""Trailing windows over tick buckets: n, mean and squared deviation.

The last W buckets before a boundary lie in at most two blocks of W: the tail of
one and the head of the next. So one forward and one backward running pass per
(key, block) give every window as the merge of two parts. No row is copied W
times, nothing is subtracted, and a task's group holds at most W rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from livetick.functions.timecols import grid_start

# n, mean and m2 of the non-null values of one group, all mergeable.
MOMENTS = "count({v}) AS n", "avg({v}) AS mean", "var_pop({v}) * count({v}) AS m2"


def moments_by(df: DataFrame, keys: list[str], value: str, *extra: str) -> DataFrame:
    """n, mean, m2 (and extra aggregates) per key, pre-aggregated map-side; empty groups left out."""
    return df.groupBy(*keys).agg(
        *[F.expr(e.format(v=value)) for e in MOMENTS], *[F.expr(e) for e in extra],
    ).filter("n > 0")


def merge_two(rows: DataFrame, keys: list[str], *extra: str) -> DataFrame:
    """Merge up to two (n, mean, m2) parts per key; exact for one part."""
    gap = "(max(mean) - min(mean))"
    pairs = "if(count(1) = 2, double(max(n)) * min(n), 0D)"
    return rows.groupBy(*keys).agg(*[F.expr(e) for e in (
        "sum(n) AS n",
        f"if({gap} = 0, min(mean), sum(n * mean) / sum(n)) AS mean",
        f"sum(m2) + {pairs} / sum(n) * {gap} * {gap} AS m2",
        *extra,
    )])


def sliding_moments(buckets: DataFrame, keys: list[str], width: int, filled_only: bool = False, sums: tuple[str, ...] = ()) -> DataFrame:
    """Moments of the ``width`` buckets ending at each k, for every k with a non-empty window.

    ``n_current`` is the count of bucket k itself, 0 where it is empty; with
    ``filled_only`` such k are left out. ``sums`` are further columns of whole
    numbers, decimal(38,0), that are added up over the window as they are.

    Both passes change value only at some k, so what is shuffled between the blocks
    are these changes, about two per bucket. Ticks are written out at the very end.
    """
    group = "PARTITION BY " + ", ".join([*keys, "_start"])
    near = f"({group} ORDER BY k)"
    whole = f"({group} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    upto = f"({group} ORDER BY k ROWS UNBOUNDED PRECEDING)"
    since = f"({group} ORDER BY k DESC ROWS UNBOUNDED PRECEDING)"

    def folds(p: str, over: str) -> list[str]:
        return [
            f"sum(n) OVER {over} AS {p}n", f"sum(n * (mean - _c)) OVER {over} AS {p}1",
            f"sum(m2 + n * (mean - _c) * (mean - _c)) OVER {over} AS {p}2",
            *[f"sum({x}) OVER {over} AS {p}{x}" for x in sums],
        ]

    def value(p: str, current: str) -> str:
        return (
            f"struct(k AS at, {p}n AS n, _c + {p}1 / {p}n AS mean, "
            f"greatest(0D, {p}2 - {p}1 * {p}1 / {p}n) AS m2, {current} AS n_current"
            + "".join(f", {p}{x} AS {x}" for x in sums) + ")"
        )

    rows = buckets.selectExpr(*keys, "k", "n", "mean", "m2", *sums, f"{grid_start('k', width)} AS _start")
    # Sums are taken around a value of the block itself, so large means lose no digits.
    rows = rows.selectExpr(
        "*", f"lead(k) OVER {near} AS _next", f"lag(k) OVER {near} AS _prev", f"first(mean) OVER {whole} AS _c",
    ).selectExpr("*", *folds("_f", upto)).selectExpr("*", *folds("_b", since))

    # A head holds from k on. The tail from j on belongs to the window that ends width - 1
    # later, one block on, and also serves the empty buckets before j. After the last one comes none.
    none = "struct(k AS at, 0L AS n, 0D AS mean, 0D AS m2, 0L AS n_current" + "".join(f", CAST(0 AS decimal(38,0)) AS {x}" for x in sums) + ")"
    unset = "CAST(NULL AS struct<at: bigint, n: bigint, mean: double, m2: double, n_current: bigint" + "".join(f", {x}: decimal(38,0)" for x in sums) + ">)"
    tail_from = f"coalesce(_prev + 1, _start + 1) + {width - 1}L"
    changes = rows.selectExpr(*keys, f"""inline(array(
        struct(_start AS block, k AS p, {value('_f', 'n')} AS head, {unset} AS tail),
        struct(_start + {width}L AS block, if(k > _start, {tail_from}, NULL) AS p, {unset} AS head, {value('_b', '0L')} AS tail),
        struct(_start + {width}L AS block, if(_next IS NULL, k + {width}L, NULL) AS p, {unset} AS head, {none} AS tail)))""",
    ).filter("p IS NOT NULL")

    at = "PARTITION BY " + ", ".join([*keys, "block"]) + " ORDER BY p"
    peers = f"({at} RANGE UNBOUNDED PRECEDING)"  # a head and a tail may change together
    steps = changes.selectExpr(
        *keys, "p", f"lead(p) OVER ({at}) AS _until", f"block + {width - 1}L AS _end",
        f"last(head, true) OVER {peers} AS h", f"last(tail, true) OVER {peers} AS t",
    ).selectExpr(
        *keys, "p", "coalesce(_until - 1, _end) AS _last", "h.at AS _at", "coalesce(h.n_current, 0L) AS _own",
        "coalesce(h.n, 0L) AS _hn", "coalesce(t.n, 0L) AS _tn", "coalesce(h.mean, t.mean) AS _mean",
        "if(t.n > 0, t.mean, h.mean) - coalesce(h.mean, t.mean) AS _gap",
        "coalesce(h.m2, 0D) + coalesce(t.m2, 0D) AS _m2",
        *[f"CAST(coalesce(h.{x}, 0) + coalesce(t.{x}, 0) AS decimal(38,0)) AS {x}" for x in sums],
    ).filter("p <= _last AND _hn + _tn > 0")
    merged = [
        "_hn + _tn AS n", "_mean + _gap * _tn / (_hn + _tn) AS mean",
        "_m2 + _gap * _gap * _hn * _tn / (_hn + _tn) AS m2", *sums,
    ]
    if filled_only:
        return steps.filter("p = _at").selectExpr(*keys, "p AS k", *merged, "_own AS n_current")
    return steps.selectExpr(*keys, "explode(sequence(p, _last)) AS k", *merged, "_at", "_own").selectExpr(
        *keys, "k", "n", "mean", "m2", *sums, "if(k = _at, _own, 0L) AS n_current",
    )


def deviation(n: str, m2: str, ddof: int = 0) -> str:
    """Standard deviation of merged moments; null when n <= ddof."""
    return f"if({n} > {ddof}, sqrt(greatest(0D, {m2}) / ({n} - {ddof})), CAST(NULL AS double))"
