"""Sigma-threshold counts and their interpolation, as SQL expression text."""

from __future__ import annotations

from fractions import Fraction

from livetick.schema import DEFAULT_THRESHOLDS

# A sample on the cutoff is not counted. The mean of a distributed job depends on the
# order of its parts in the last bits, so "on the cutoff" reaches a few of them, 8 units
# in the last place of the mean.
CUTOFF_ULPS = 8 * 2.0**-52


def threshold_array(thresholds: tuple[float, ...] | None = None) -> str:
    """The configured thresholds as a literal array; the defaults when none are known yet."""
    return "array(" + ", ".join(f"{float(t)!r}D" for t in (thresholds or DEFAULT_THRESHOLDS)) + ")"


def beyond(value: str, avg: str, sd: str, threshold: float, side: str,
           ulps: float = CUTOFF_ULPS) -> str:
    """Whether a sample lies strictly more than threshold * sd above (or below) the mean; false without one."""
    diff = f"{value} - {avg}" if side == "above" else f"{avg} - {value}"
    slack = f"{ulps!r}D * abs({avg})"
    return f"coalesce({diff} > {float(threshold)!r}D * {sd} + {slack}, false)"


def whole(value: str, places: int) -> str:
    """A reading in units of its last decimal place; null where it is no such number (not finite, or beyond 13 digits)."""
    return f"if(abs({value}) < {10.0 ** (13 - places)!r}D, bigint(round({value} * {10.0 ** places!r}D)), CAST(NULL AS bigint))"


#: Of whole numbers x in a window: their sum, the sum of their squares and how many readings have none.
WHOLE_SUMS = {"_s": "sum(CAST(_x AS decimal(19,0)))", "_q": "sum(CAST(_x AS decimal(19,0)) * _x)", "_u": "count(cpu) - count(_x)"}


def whole_spread(n: str = "n") -> list[list[str]]:
    """Columns, in steps, that turn the sums of ``WHOLE_SUMS`` into ``_mid``, ``_off`` and ``_v``, all whole numbers.

    The mean is ``_mid + _off / n`` and the variance ``_v / (n * n)``. Null where a reading is no whole number or
    38 digits do not hold the numbers.
    """
    d = "decimal(38,0)"
    return [
        [f"if(_u = 0, bigint(round(double(_s) / {n})), CAST(NULL AS bigint)) AS _mid"],
        [f"try_subtract(_s, try_multiply(CAST({n} AS {d}), CAST(_mid AS {d}))) AS _off",
         f"try_add(try_subtract(_q, try_multiply(CAST(2 * _mid AS {d}), _s)), try_multiply(try_multiply(CAST(_mid AS {d}), CAST(_mid AS {d})), CAST({n} AS {d}))) AS _around"],
        [f"try_subtract(try_multiply(CAST({n} AS {d}), CAST(_around AS {d})), try_multiply(CAST(_off AS {d}), CAST(_off AS {d}))) AS _v"],
    ]


def whole_near(threshold: float, side: str, n: str = "n") -> str:
    """About where the cutoff lies among whole numbers, by doubles: at most one off."""
    fit, sign = ("floor", "+") if side == "above" else ("ceil", "-")
    return f"_mid + bigint({fit}(double(_off) / {n} {sign} {float(threshold)!r}D * sqrt(double(_v)) / {n}))"


def whole_cutoff(threshold: float, side: str, near: str, n: str = "n") -> str:
    """The last whole number, counted away from the mean, that does not lie beyond threshold * sd; null if unknown."""
    level, sign, d = Fraction(str(float(threshold))), 1 if side == "above" else -1, "decimal(38,0)"

    def passes(x: str) -> str:
        gap = f"try_subtract(try_multiply(CAST({n} AS {d}), CAST({x} - _mid AS {d})), CAST(_off AS {d}))"
        scaled = f"CAST(try_multiply(CAST({gap} AS {d}), CAST({level.denominator} AS {d})) AS {d})"
        far = f"try_multiply({scaled}, {scaled}) > try_multiply(CAST(_v AS {d}), CAST({level.numerator ** 2} AS {d}))"
        return f"(double({gap}) * {sign} > 0D AND {far})"

    return f"{near} + CASE WHEN NOT {passes(f'({near} + {sign}L)')} THEN {sign}L WHEN NOT {passes(near)} THEN 0L WHEN {passes(near)} THEN {-sign}L END"


def sigma_counts(samples: str, avg: str, sd: str, side: str,
                 thresholds: tuple[float, ...] = DEFAULT_THRESHOLDS) -> str:
    """Per threshold, how many samples of an array lie beyond it; all zero without a baseline."""
    return "array(" + ", ".join(
        f"cast(greatest(0, size(filter({samples}, x -> {beyond('x', avg, sd, t, side)}))) AS bigint)"
        for t in thresholds
    ) + ")"


def count_at_sigma(counts: str, sigma: str | float, thresholds: str | None = None, log: bool = False) -> str:
    """The count at any sigma, interpolated between the ascending thresholds.

    Clamped to the end counts; 0 for empty or unequal arrays. ``log`` interpolates
    the logarithm of the counts where both are positive.
    """
    at = thresholds or threshold_array()
    sigma = f"{float(sigma)!r}D" if not isinstance(sigma, str) else sigma
    below = f"size(filter({at}, t -> t < {sigma}))"
    lo_t, hi_t = f"get({at}, {below} - 1)", f"get({at}, {below})"
    lo, hi = f"get({counts}, {below} - 1)", f"get({counts}, {below})"
    part = f"if({hi_t} = {lo_t}, 0D, ({sigma} - {lo_t}) / nullif({hi_t} - {lo_t}, 0D))"
    between = f"{lo} + ({hi} - {lo}) * {part}"
    if log:
        curved = f"exp(ln({lo}) + (ln({hi}) - ln({lo})) * {part})"
        between = f"if({lo} > 0 AND {hi} > 0, {curved}, {between})"
    return f"""cast(CASE
        WHEN coalesce(size({at}), 0) <= 0 OR coalesce(size({counts}), -1) <> size({at}) THEN 0D
        WHEN {below} = 0 THEN get({counts}, 0)
        WHEN {below} = size({at}) THEN get({counts}, size({at}) - 1)
        ELSE {between} END AS double)"""


def dot_radius(count: str) -> str:
    """Dot size: 1.5 + 1.5 * log10(count + 1), kept within 1.5 and 8."""
    return f"greatest(1.5D, least(8D, 1.5D + 1.5D * log10({count} + 1)))"


def dot_opacity(count: str) -> str:
    """Dot opacity: 0.4 + 0.15 * log10(count + 1), at most 0.95."""
    return f"least(0.95D, 0.4D + 0.15D * log10({count} + 1))"
