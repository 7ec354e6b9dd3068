"""The host dimension: discovery, enabling and display order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def discover(events: DataFrame, dimension: DataFrame) -> DataFrame:
    """Hosts present in the data, restricted to the dimension, with their declared rank."""
    return dimension.join(events.select("host").distinct(), "host", "left_semi")


def enabled(events: DataFrame, disabled: DataFrame) -> DataFrame:
    """Rows of hosts that are not switched off."""
    return events.join(disabled.select("host"), "host", "left_anti")


def ranked_hosts(rows: DataFrame, dimension: DataFrame) -> DataFrame:
    """Attach the declared rank; unknown hosts follow, by name."""
    return rows.join(dimension, "host", "left").orderBy(F.col("rank").asc_nulls_last(), "host")


def high_value(events: DataFrame, threshold: float, disabled: DataFrame) -> DataFrame:
    """Events of enabled hosts strictly above a threshold."""
    return enabled(events.filter(F.col("cpu") > threshold), disabled)
