"""Sinks for results. Rows stay distributed; nothing is gathered to write a file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointproc.operators.connectivity import dead_channels, symmetric
from pointproc.params import METRIC_LABELS
from pointproc.sources.electrodes import electrodes

SHORT_VECTOR = 8


def flat_row(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Array columns of 2..8 elements become name_1 .. name_k; ``sizes`` gives k.

    Longer arrays keep their name and are left to JSON.
    """
    out: list[Column] = []
    for f in df.schema:
        k = sizes.get(f.name, 0)
        if isinstance(f.dataType, T.ArrayType) and 2 <= k <= SHORT_VECTOR:
            out += [F.get(f.name, F.lit(i)).alias(f"{f.name}_{i + 1}") for i in range(k)]
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def _text(f: T.StructField) -> Column:
    """CSV text of a scalar: ten significant digits, NaN and Inf spelled out."""
    c = F.col(f.name)
    if isinstance(f.dataType, T.BooleanType):
        return c.cast("int").cast("string")
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        sci = F.format_string("%.9e", d)
        # the value at ten significant digits, and its decimal exponent
        ten, exp = sci.cast("double"), F.regexp_extract(sci, r"e(.*)$", 1).cast("int")
        mantissa = F.regexp_replace(F.regexp_extract(sci, r"^(.*)e", 1), r"\.?0+$", "")
        sign = F.when(exp < 0, "-").otherwise("+")
        short = F.concat(mantissa, F.lit("e"), sign, F.lpad(F.abs(exp).cast("string"), 2, "0"))
        plain = F.regexp_replace(ten.cast("decimal(38,14)").cast("string"), r"\.?0+$", "")
        return (F.when(d.isNull() | F.isnan(d), F.lit("NaN")).when(d == float("inf"), "Inf")
                .when(d == float("-inf"), "-Inf").when(d == 0, "0")
                .when((exp < -4) | (exp >= 10), short).otherwise(plain))
    return c.cast("string")


def export_stats(df: DataFrame, path: str, sizes: dict[str, int] | None = None) -> None:
    """CSV of the scalars and JSON of everything, as ``path``_csv and ``path``_json."""
    flat = flat_row(df, sizes or {})
    scalars = [f for f in flat.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    write_csv(flat.select(*[_text(f).alias(f.name) for f in scalars]), f"{path}_csv")
    flat.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}_json")


def write_csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("nanValue", "NaN").option("nullValue", "NaN").option("emptyValue", "").csv(path))


def _label(metric: str = "metric") -> Column:
    """The metric's name for output; a metric without one keeps its key."""
    names = F.create_map(*[F.lit(x) for kv in METRIC_LABELS.items() for x in kv])
    return F.coalesce(names[F.col(metric)], F.col(metric)).alias("metric")


def sweep_rows(sweep: DataFrame) -> DataFrame:
    return sweep.select("study", F.col("pair_no").alias("pair"), "target_density", _label(),
                        F.col("b").alias("baseline"), F.col("t").alias("treatment"), "delta")


def method_rows(observations: DataFrame) -> DataFrame:
    return observations.select("study", F.col("pair_no").alias("pair"), _label(),
                               F.col("b").alias("baseline"), F.col("t").alias("treatment"), "delta")


def matrix_rows(edges: DataFrame, reference: int = 15, dead: DataFrame | None = None) -> DataFrame:
    """Long form of the matrix: live channels only, both orientations, electrode labels."""
    spark = edges.sparkSession
    dim = F.broadcast(electrodes(spark).select("channel", "label"))
    live = (dead_channels(edges, reference) if dead is None else dead).filter("NOT dead").select("recording_id", "channel")
    rows = symmetric(edges).join(live, ["recording_id", "channel"], "left_semi").join(
        live.withColumnRenamed("channel", "other"), ["recording_id", "other"], "left_semi")
    return (rows.join(dim, "channel").withColumnRenamed("label", "label_i")
            .join(dim.withColumnRenamed("channel", "other").withColumnRenamed("label", "label_j"), "other")
            .select("recording_id", "label_i", "label_j", "w"))


def dense_matrix(rows: DataFrame, labels: Sequence[int]) -> DataFrame:
    """One row per electrode label, one column per label (at most 60)."""
    return rows.groupBy("recording_id", "label_i").pivot("label_j", sorted(labels)).agg(F.first("w"))


def correlogram_rows(correlograms: DataFrame, recordings: DataFrame) -> DataFrame:
    """lag, baseline, treatment per pair of channels."""
    rows = correlograms.join(recordings.select("recording_id", "study", "pair_no", "condition"), "recording_id")
    at = F.col("condition") == "baseline"
    return rows.groupBy("study", "pair_no", "i", "j", "lag_us").agg(
        F.max(F.when(at, F.col("r"))).alias("baseline"), F.max(F.when(~at, F.col("r"))).alias("treatment"))


def write_edges(edges: DataFrame, recordings: DataFrame, path: str) -> None:
    (edges.join(recordings.select("recording_id", "study", "pair_no", "condition"), "recording_id")
     .write.mode("overwrite").partitionBy("study", "pair_no").parquet(path))
