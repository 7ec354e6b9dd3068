"""Text forms of statistics and ages, as SQL expression text."""

from __future__ import annotations


def percent_text(value: str) -> str:
    """A fraction as percent with one decimal; a dash for null."""
    return f"if({value} IS NULL, '—', format_string('%.1f%%', {value} * 100))"


def age_text(age_ms: str) -> str:
    """'future' below zero, milliseconds below a second, else seconds with one decimal."""
    return (
        f"CASE WHEN {age_ms} < 0 THEN 'future' WHEN {age_ms} < 1000 THEN concat({age_ms}, 'ms') "
        f"ELSE format_string('%.1fs', {age_ms} / 1000) END"
    )
