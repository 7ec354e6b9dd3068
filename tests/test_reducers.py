"""Output maps, user functions of sub-series, parts of slices and frames."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from livetick.operators import bands, custom, rollups, ticks
from livetick.schema import contract_report
from livetick.sources import frames


def test_reducers_that_return_values_and_lists(make_events):
    rows = [(3, 1.0, 5, "a"), (1, 4.0, 5, "a"), (2, 4.0, 7, "a"), (9, -2.0, 6, "a"), (4, 9.0, 1, "b")]
    events = make_events(rows).withColumn("cpu", F.when(F.col("seq") != 0, F.col("cpu"))).withColumn("other", F.lit(None).cast("double"))
    got = {r.host: r for r in rollups.reduce_by(
        events, ["host"], u=("requests", "unique"), s=("cpu", "samples"), top2=("cpu", "top2"), top9=("cpu", "top9"), none=("other", "top3"),
        f=("cpu", "first"), la=("cpu", "last"), n=("cpu", "count")).collect()}
    a = got["a"]
    assert (a.u, a.s, a.top2, a.top9, a.none, a.f, a.la, a.n) == ([5, 6, 7], [-2.0, 4.0, 4.0], [4.0, 4.0], [4.0, 4.0, -2.0], [], 4.0, -2.0, 3)
    assert rollups.reduce_by(events, ["host"], top1=("cpu", "top1")).columns == ["host", "top1"]


@pytest.mark.parametrize("rows_each, chunk", [(7, 10), (1, 3), (1000, 1000)])
def test_series_apply_sees_bounded_sub_series_in_order(spark, make_events, rows_each, chunk):
    """Two thirds of the rows come from one host; no call sees more than the stated rows."""
    events = make_events([(i, float(i * 37 % 11), i, "hot" if i % 3 else "b") for i in range(100)]).repartition(5)

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": pdf["host"][:1], "part": pdf["part"][:1], "seqs": [pdf["seq"].tolist()]})

    got = custom.series_apply(events.select("seq", "host", "cpu"), "host", call, "host string, part bigint, seqs array<bigint>", rows_each, chunk).collect()
    want = []
    for host in ("hot", "b"):
        own = [i for i in range(100) if (i % 3 > 0) == (host == "hot")]
        want += [(host, p // rows_each, own[p : p + rows_each]) for p in range(0, len(own), rows_each)]
    assert sorted((r.host, r.part, r.seqs) for r in got) == sorted(want)
    assert max(len(r.seqs) for r in got) <= rows_each


def test_parts_of_a_slice_follow_arrival(make_events):
    rows = [(100, float(9 - i), 1, "a") for i in range(10)] + [(700, 1.0, 1, "a")]
    events = make_events(rows).withColumn("cpu", F.when(~F.col("seq").isin(3, 10), F.col("cpu")))
    for shuffled in (events, events.repartition(4)):
        got = sorted((r.ts_us, r.part, r.n_current, r.samples) for r in ticks.slice_samples(shuffled, "500ms", part_rows=4).collect())
        assert got == [(500_000, 0, 9, [5.0, 7.0, 8.0, 9.0]), (500_000, 1, 9, [1.0, 2.0, 3.0, 4.0]), (500_000, 2, 9, [0.0]), (1_000_000, 0, 0, [])]


def test_contract_report_looks_at_the_order(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "a bigint, b string, c double")
    declared = T.StructType([T.StructField("b", T.StringType(), False), T.StructField("a", T.LongType(), False), T.StructField("c", T.DoubleType(), False), T.StructField("d", T.LongType())])
    got = {r.field: (r.actual_pos, r.in_order, r.ok) for r in contract_report(df, declared).collect()}
    assert got == {"b": (1, True, True), "a": (0, False, False), "c": (2, True, True), "d": (None, False, False)}


def test_wide_table_takes_hosts_it_was_not_told_of(spark):
    rows = spark.createDataFrame([(1, "b", 1.0), (1, "new", 2.0), (2, "also", 3.0), (2, None, 4.0)], "ts_us bigint, host string, v double")
    wide = bands.wide_by_time(rows, ["b", "declared"], ["v"])
    assert wide.columns == ["ts_us", "b", "declared", "also", "new"]
    assert sorted(map(tuple, wide.collect())) == [(1, 1.0, None, None, 2.0), (2, None, None, 3.0, None)]
    with pytest.raises(ValueError):
        bands.wide_by_time(rows, ["b"], ["v"], most=2)


def test_frames_of_many_hosts_come_in_parts(spark, make_events):
    events = make_events([(i * 10, float(i), 1, f"h{i % 30}") for i in range(300)])
    rows = ticks.host_ticks(events, "500ms", "1s")
    whole, parts = frames.aggregate_frames(rows), frames.aggregate_frames(rows, hosts_each=4)
    assert whole.count() < parts.count() and parts.agg(F.max("n_rows")).first()[0] < 15

    def decoded(encoded):
        return sorted(map(repr, frames.decode_ticks(encoded).collect()))

    assert decoded(whole) == decoded(parts) and len(decoded(whole)) == rows.count()
