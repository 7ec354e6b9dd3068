"""Required-column validation at the edge of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def split_required(df: DataFrame, required: list[str]) -> DataFrame:
    """Tag every row: ``status`` is good or quarantine, ``missing`` lists null required columns."""
    missing = F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda c: c.isNotNull()
    )
    tagged = df.withColumn("missing", missing)
    return tagged.withColumn(
        "status", F.when(F.size("missing") == 0, F.lit("good")).otherwise(F.lit("quarantine"))
    )


def accept(df: DataFrame, required: list[str], policy: str = "drop") -> DataFrame:
    """Rows with every required column set; policy 'fail' raises on the first bad row."""
    bad = F.lit(False)
    for c in required:
        bad = bad | F.col(c).isNull()
    if policy == "drop":
        return df.filter(~bad)
    if policy == "fail":
        failed = F.raise_error(F.lit("null in a required column")).cast("boolean")
        return df.filter(F.when(bad, failed).otherwise(F.lit(True)))
    raise ValueError(f"unknown policy {policy!r}")
