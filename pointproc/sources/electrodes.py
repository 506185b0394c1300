"""The 60-electrode array: a fixed dimension of 60 rows.

Being a property of the device and not of the data, it and its 1,770 electrode
pairs have a proven size and may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointproc.functions.scalar import euclid

# Electrode label of pins 1..60 (tens digit = column, ones = row).
LABELS = (
    47, 48, 46, 45, 38, 37, 28, 36, 27, 17, 26, 16, 35, 25, 15, 14, 24, 34, 13, 23,
    12, 22, 33, 21, 32, 31, 44, 43, 41, 42, 52, 51, 53, 54, 61, 62, 71, 63, 72, 82,
    73, 83, 64, 74, 84, 85, 75, 65, 86, 76, 87, 77, 66, 78, 67, 68, 55, 56, 58, 57,
)
ABSENT_LABELS = (11, 18, 81, 88)
KNOWN_DISTANCES = {(44, 45): 1.0, (44, 54): 1.0, (44, 55): 2.0**0.5, (21, 78): 74.0**0.5}
GROUND = (16, 32, 48, 64)
REFERENCE_LABEL = 15


def channel_of_pin(pin: Column) -> Column:
    """Amplifier channel of a pin: every sixteenth channel is ground."""
    return (pin + F.floor((pin - 1) / 15)).cast("int")


def electrodes(spark: SparkSession) -> DataFrame:
    """channel, pin, label, grid_row, grid_col, x, y."""
    labels = F.array(*[F.lit(v) for v in LABELS])
    base = spark.range(1, 61).select(
        F.col("id").cast("int").alias("pin"),
        F.element_at(labels, F.col("id").cast("int")).alias("label"),
    )
    col, row = F.floor(F.col("label") / 10).cast("int"), F.col("label") % 10
    return base.select(
        channel_of_pin(F.col("pin")).alias("channel"), "pin", "label",
        row.alias("grid_row"), col.alias("grid_col"), col.alias("x"), (9 - row).alias("y"),
    )


def signal_channels(df: DataFrame, channel: str = "channel") -> DataFrame:
    """Keep rows of signal channels; ground never passes, the reference does."""
    c = F.col(channel)
    return df.filter(c.between(1, 63) & ~c.isin(*GROUND))


def electrode_pairs(spark: SparkSession) -> DataFrame:
    """Pairs i < j of channels with labels and distance: 1,770 rows."""
    e = electrodes(spark)
    left = e.select(F.col("channel").alias("i"), F.col("label").alias("label_i"),
                    F.col("x").alias("xi"), F.col("y").alias("yi"), "pin")
    right = e.select(F.col("channel").alias("j"), F.col("label").alias("label_j"),
                     F.col("x").alias("xj"), F.col("y").alias("yj"), F.col("pin").alias("pin_j"))
    # each electrode lists the pins after its own, so the self-join is on equality
    later = left.filter("pin < 60").withColumn("pin_j", F.explode(F.sequence(F.col("pin") + 1, F.lit(60))))
    return later.join(F.broadcast(right), "pin_j").select(
        "i", "j", "label_i", "label_j",
        euclid(F.col("xi") - F.col("xj"), F.col("yi") - F.col("yj")).alias("dist"))


def validate_electrodes(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per check of the electrode table: ``check``, ``pass``."""
    label, ch = F.col("label"), F.col("channel")
    expected_channels = [c for c in range(1, 64) if c not in GROUND]
    facts = table.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("label").alias("n_labels"),
        F.array_sort(F.collect_set("channel")).alias("channels"),
        F.count_if(label.isin(*ABSENT_LABELS)).alias("n_absent"),
        F.count_if(label == REFERENCE_LABEL).alias("n_ref"),
        F.count_if(~F.floor(label / 10).between(1, 8) | ~(label % 10).between(1, 8)).alias("n_digits"),
        F.count_if(label == F.element_at(F.array(*[F.lit(v) for v in LABELS]), F.col("pin"))).alias("n_pin"),
        F.count_if(ch == 15).alias("n_ref_channel"),
    )
    known = [
        F.max(F.when((F.least("label_i", "label_j") == a) & (F.greatest("label_i", "label_j") == b),
                     F.abs(F.col("dist") - d) < 1e-10)).alias(f"d{a}_{b}")
        for (a, b), d in KNOWN_DISTANCES.items()
    ]
    geometry = pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.min("dist").alias("min_dist"), *known)
    table_checks = {
        "n_electrodes": F.col("n") == 60,
        "labels_unique": F.col("n_labels") == 60,
        "channel_list": F.col("channels") == F.array(*[F.lit(c) for c in expected_channels]),
        "corners_absent": F.col("n_absent") == 0,
        "reference_present": F.col("n_ref") == 1,
        "label_digits": F.col("n_digits") == 0,
        "pin_table": F.col("n_pin") == 60,
        "reference_channel": F.col("n_ref_channel") == 1,
    }
    pair_checks = {
        "pair_count": F.col("n_pairs") == 1770,
        "distances_positive": F.col("min_dist") >= 1,
        **{f"distance_{a}_{b}": F.col(f"d{a}_{b}") for a, b in KNOWN_DISTANCES},
    }

    def rows(facts: DataFrame, checks: dict[str, Column]) -> DataFrame:
        return facts.select(F.inline(F.array(*[
            F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("pass")) for k, v in checks.items()])))

    return rows(facts, table_checks).unionByName(rows(geometry, pair_checks))
