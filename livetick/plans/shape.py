"""Output shape of the registered queries, so that two engines can be compared by value."""

from __future__ import annotations

from livetick.functions.timecols import to_ms

# Means of two-decimal values often end exactly half-way at the sixth decimal, where
# engines round differently. This shift is smaller than the rounding step and moves
# such values off the half-way point.
SHIFT = 3.3e-8


def num(expr: str, name: str | None = None) -> str:
    """A float rounded to six decimals."""
    return f"round({expr} + {SHIFT!r}D, 6) AS {name or expr}"


def ms(col: str = "ts_us", name: str = "ts_ms") -> str:
    return f"{to_ms(col)} AS {name}"


def flat(col: str) -> str:
    """An array as comma-separated text."""
    return f"array_join(transform({col}, x -> string(x)), ',') AS {col}"
