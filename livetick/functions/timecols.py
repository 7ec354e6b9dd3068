"""Durations and epoch arithmetic on microsecond columns, as SQL expression text."""

from __future__ import annotations

import re

_UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}


def duration_us(text: str | int) -> int:
    """Microseconds of a duration such as '200ms', '15s', '1m', '24h'; ints pass through."""
    if isinstance(text, int):
        return text
    match = re.fullmatch(r"(\d+)\s*(us|ms|s|m|h|d)", text.strip())
    if match is None:
        raise ValueError(f"not a duration: {text!r}")
    return int(match.group(1)) * _UNITS[match.group(2)]


def micros(ts: str) -> str:
    """Epoch microseconds of a timestamp (NTZ is read as UTC)."""
    return f"unix_micros(cast({ts} AS timestamp))"


def grid(col: str, step: int) -> str:
    """Grid index floor(col / step) in integer arithmetic, right below zero as well."""
    return f"(({col} - pmod({col}, {step}L)) div {step}L)"


def grid_start(col: str, step: int) -> str:
    """Start of the grid cell that holds col."""
    return f"({col} - pmod({col}, {step}L))"


def to_ms(us: str) -> str:
    return grid(us, 1_000)
