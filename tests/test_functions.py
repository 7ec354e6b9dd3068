import pytest
from pyspark.sql import functions as F

from livetick.functions.display import age_text, percent_text
from livetick.functions.sigma import count_at_sigma, dot_opacity, dot_radius, sigma_counts, threshold_array
from livetick.functions.timecols import duration_us, grid

THRESHOLDS = threshold_array()


def one(spark, expr):
    return spark.range(1).select(F.expr(f"{expr} AS v")).first()["v"]


def doubles(values):
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")" if values else "CAST(array() AS array<double>)"


@pytest.mark.parametrize("avg, sd, samples, above, below", [
    ("CAST(NULL AS double)", "CAST(NULL AS double)", [0.5, 0.6], [0] * 5, [0] * 5),
    ("0.5D", "0.1D", [], [0] * 5, [0] * 5),
    ("0.5D", "0.1D", [0.55, 0.62, 0.72, 0.82, 0.92, 1.05], [5, 4, 4, 3, 3], [0] * 5),
    ("0.5D", "0.1D", [0.45, 0.38, 0.30, 0.65, 0.72, 0.95], [3, 2, 2, 1, 1], [2, 1, 0, 0, 0]),
    ("0.5D", "0D", [0.5, 0.5, 0.5], [0] * 5, [0] * 5),
    ("0.5D", "0D", [0.6, 0.5, 0.4], [1] * 5, [1] * 5),
])
def test_sigma_counts(spark, avg, sd, samples, above, below):
    assert one(spark, sigma_counts(doubles(samples), avg, sd, "above")) == above
    assert one(spark, sigma_counts(doubles(samples), avg, sd, "below")) == below


@pytest.mark.parametrize("counts, sigma, want", [
    ([876, 62, 12, 1, 0], 1.25, 469),
    ([100, 50, 25, 10, 5], 0, 100), ([100, 50, 25, 10, 5], 0.5, 100), ([100, 50, 25, 10, 5], 1, 100),
    ([100, 50, 25, 10, 5], 1.5, 50), ([100, 50, 25, 10, 5], 2.0, 25), ([100, 50, 25, 10, 5], 2.5, 10),
    ([100, 50, 25, 10, 5], 1.75, 37.5), ([100, 50, 25, 10, 5], 2.25, 17.5),
    ([100, 50, 25, 10, 5], 3, 5), ([100, 50, 25, 10, 5], 3.5, 5), ([100, 50, 25, 10, 5], 10, 5),
    ([], 2, 0), ([1, 2, 3], 2, 0), ([1, 2, 3, 4, 5, 6], 2, 0), ([0] * 5, 2, 0), ([0] * 5, 1.75, 0),
])
def test_count_at_sigma(spark, counts, sigma, want):
    assert one(spark, count_at_sigma(doubles(counts), float(sigma))) == pytest.approx(want)


def test_count_at_sigma_without_thresholds(spark):
    assert one(spark, count_at_sigma(doubles([1, 2]), 2.0, "CAST(array() AS array<double>)")) == 0


def test_count_at_sigma_equal_thresholds(spark):
    assert one(spark, count_at_sigma(doubles([8, 4, 2]), 2.0, doubles([1, 2, 2]))) == 4


def test_log_interpolation(spark):
    assert one(spark, count_at_sigma(doubles([876, 62, 12, 1, 0]), 1.25, log=True)) == pytest.approx(233, abs=0.5)
    # linear next to a zero count
    assert one(spark, count_at_sigma(doubles([876, 62, 12, 1, 0]), 2.75, log=True)) == pytest.approx(0.5)


@pytest.mark.parametrize("count, radius", [(1, 1.95), (10, 3.06), (100, 4.5), (1000, 6.0), (1e9, 8.0)])
def test_dot_radius(spark, count, radius):
    assert one(spark, dot_radius(f"{count!r}D")) == pytest.approx(radius, abs=0.01)


def test_dot_opacity(spark):
    assert one(spark, dot_opacity("0D")) == pytest.approx(0.4)
    assert one(spark, dot_opacity("1e9D")) == pytest.approx(0.95)


def test_display_texts(spark):
    assert one(spark, percent_text("0.1234D")) == "12.3%"
    assert one(spark, percent_text("CAST(NULL AS double)")) == "—"
    assert [one(spark, age_text(f"{v}L")) for v in (-1, 999, 1500)] == ["future", "999ms", "1.5s"]


def test_durations_and_grid(spark):
    assert [duration_us(t) for t in ("200ms", "15s", "1m", "24h", "7d", 5)] == [
        200_000, 15_000_000, 60_000_000, 86_400_000_000, 604_800_000_000, 5]
    with pytest.raises(ValueError):
        duration_us("soon")
    assert [one(spark, grid(f"({v}L)", 5)) for v in (-6, -5, -1, 0, 4, 5)] == [-2, -1, -1, 0, 0, 1]
