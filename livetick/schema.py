"""Fixed schemas and deploy-time constants shared by every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# The sigma thresholds anomaly counts are taken at.
DEFAULT_THRESHOLDS = (1.0, 1.5, 2.0, 2.5, 3.0)

# The declared hosts, in display order.
DEFAULT_HOSTS = ("api-1", "api-2", "api-3", "api-4", "api-5", "api-6", "api-7", "api-8")

EVENT = T.StructType([
    T.StructField("time", T.TimestampType(), False),
    T.StructField("cpu", T.DoubleType(), False),
    T.StructField("requests", T.LongType(), False),
    T.StructField("host", T.StringType(), False),
])

# The event as it travels: time as epoch milliseconds.
WIRE_EVENT = T.StructType([
    T.StructField("time_ms", T.LongType(), False),
    T.StructField("cpu", T.DoubleType(), False),
    T.StructField("requests", T.LongType(), False),
    T.StructField("host", T.StringType(), False),
])

EVENT_BATCH = T.StructType([
    T.StructField("events", T.ArrayType(WIRE_EVENT, containsNull=False), False),
])

REFERENCE_LINE = T.StructType([
    T.StructField("time", T.TimestampType(), False),
    T.StructField("cpu", T.DoubleType(), False),
])

HOST_TICK = T.StructType([
    T.StructField("ts", T.LongType(), False),
    T.StructField("host", T.StringType(), False),
    T.StructField("cpu_avg", T.DoubleType(), True),
    T.StructField("cpu_sd", T.DoubleType(), True),
    T.StructField("cpu_n", T.LongType(), False),
    T.StructField("n_current", T.LongType(), False),
    T.StructField("anomalies_above", T.ArrayType(T.LongType()), False),
    T.StructField("anomalies_below", T.ArrayType(T.LongType()), False),
])

_KINDS = {
    T.TimestampType: "time",
    T.TimestampNTZType: "time",
    T.DoubleType: "number",
    T.FloatType: "number",
    T.LongType: "number",
    T.IntegerType: "number",
    T.StringType: "string",
    T.BooleanType: "boolean",
    T.ArrayType: "array",
}


def kind_of(data_type: T.DataType) -> str:
    """time, number, string, boolean or array; anything else is 'unknown'."""
    return _KINDS.get(type(data_type), "unknown")


def contract_differences(declared: T.StructType, wire: T.StructType) -> list[tuple[int, str, str]]:
    """Positional differences between a declared schema and its wire form.

    Order, name and kind must agree. A time field may carry its unit on the
    wire, as ``<name>_ms`` holding an epoch number.
    """
    found = []
    for pos in range(max(len(declared.fields), len(wire.fields))):
        if pos >= len(declared.fields):
            found.append((pos, wire.fields[pos].name, "not declared"))
        elif pos >= len(wire.fields):
            found.append((pos, declared.fields[pos].name, "missing on the wire"))
        else:
            want, got = declared.fields[pos], wire.fields[pos]
            as_epoch = (
                kind_of(want.dataType) == "time"
                and got.name == f"{want.name}_ms"
                and kind_of(got.dataType) == "number"
            )
            if as_epoch:
                continue
            if want.name != got.name:
                found.append((pos, want.name, f"named {got.name} on the wire"))
            elif kind_of(want.dataType) != kind_of(got.dataType):
                found.append((pos, want.name, f"{kind_of(got.dataType)} on the wire"))
    return found


def contract_report(df: DataFrame, declared: T.StructType) -> DataFrame:
    """Check a table against a declared schema: one row per declared field.

    Names, kinds and positions come from the table's schema; the null count of each field
    comes from one pass over the data, since a required field must hold none. The table may
    have further fields, but the declared ones must follow each other as declared.
    """
    actual = {f.name: f for f in df.schema.fields}
    places = {f.name: i for i, f in enumerate(df.schema.fields)}
    nulls = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[
            (F.count_if(F.col(f.name).isNull()) if f.name in actual else F.count(F.lit(1))).alias(f"nulls_{f.name}")
            for f in declared.fields
        ],
    )
    rows = []
    for pos, field in enumerate(declared.fields):
        got = kind_of(actual[field.name].dataType) if field.name in actual else "missing"
        want = kind_of(field.dataType)
        n_null = F.col(f"nulls_{field.name}")
        before = [places[f.name] for f in declared.fields[:pos] if f.name in places]
        ordered = field.name in places and places[field.name] > max(before, default=-1)
        rows.append(F.struct(
            F.lit(pos).cast("bigint").alias("pos"),
            F.lit(field.name).alias("field"),
            F.lit(want).alias("declared_kind"),
            F.lit(got).alias("actual_kind"),
            F.lit(places.get(field.name)).cast("bigint").alias("actual_pos"),
            n_null.alias("n_null"),
            F.lit(ordered).alias("in_order"),
            (F.lit(want == got and ordered) & (F.lit(field.nullable) | (n_null == 0))).alias("ok"),
        ))
    return nulls.select("n_rows", F.inline(F.array(*rows)))
