"""Reads the driver's tables as recordings, spikes, samples and observations.

Every user of ``events`` is one electrode, sixty users form one array, and the
month splits into a baseline and a treatment half. Thresholds are scaled from
milliseconds to hours accordingly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointproc.sources.electrodes import channel_of_pin

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
HALF_US = 15 * DAY_US
BLOCK_US = 3 * DAY_US
FS = 64.0

REFRACTORY_US = 600_000_000
ISI_MAX_US = 4 * HOUR_US
ISI_END_US = 8 * HOUR_US
MIN_SPIKES = 3
BIN_US = HOUR_US
MAX_LAG = 24
DELTA_US = 2 * HOUR_US
MIN_RATE = 1.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rec(user: Column) -> Column:
    return F.floor(user / 60).cast("bigint")


def _recording_id(condition: Column, rec: Column) -> Column:
    return F.concat(F.lit("events-"), condition, F.lit("_#"), (rec + 1).cast("string"))


def _study(rec: Column) -> Column:
    return F.when(rec % 3 == 2, "ket").otherwise("doi")


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, channel, t_us, duration_us."""
    split = F.expr("TIMESTAMP_NTZ'2024-01-16 00:00:00'")
    first = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")
    ev = table(spark, sf_dir, "events").select("ts", "user_id").withColumn(
        "start", F.when(F.col("ts") < split, first).otherwise(split))
    cond = F.when(F.col("ts") < split, "baseline").otherwise("treatment")
    return ev.select(
        _recording_id(cond, _rec(F.col("user_id"))).alias("recording_id"),
        channel_of_pin(F.col("user_id") % 60 + 1).alias("channel"),
        F.expr("timestampdiff(MICROSECOND, start, ts)").alias("t_us"),
        F.lit(HALF_US).cast("bigint").alias("duration_us"),
    )


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id").distinct()


def _both(df: DataFrame) -> DataFrame:
    return df.withColumn("condition", F.explode(F.array(F.lit("baseline"), F.lit("treatment"))))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = table(spark, sf_dir, "events").select(_rec(F.col("user_id")).alias("rec")).distinct()
    return _both(recs).select(
        _recording_id(F.col("condition"), F.col("rec")).alias("recording_id"),
        _study(F.col("rec")).alias("study"), "condition",
        (F.col("rec") + 1).alias("pair_no"), F.lit(FS).alias("fs"),
        F.lit(HALF_US).cast("bigint").alias("duration_us"), F.lit("2.0").alias("schema_version"))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channels each recording used, silent ones included."""
    return _both(_users(spark, sf_dir)).select(
        _recording_id(F.col("condition"), _rec(F.col("user_id"))).alias("recording_id"),
        channel_of_pin(F.col("user_id") % 60 + 1).alias("channel"),
        F.lit(HALF_US).cast("bigint").alias("duration_us"))


def samples(spark: SparkSession, sf_dir: str, fs: float = FS) -> DataFrame:
    """Embedding vectors as 64-sample chunks; the label is the channel."""
    return table(spark, sf_dir, "embeddings").select(
        F.lit("vectors-baseline_#1").alias("recording_id"),
        (F.col("label") + 1).cast("int").alias("channel"),
        F.col("vec_id").alias("chunk_no"),
        (F.col("vec_id") * 64).alias("start_idx"),
        F.lit(float(fs)).alias("fs"),
        F.col("embedding").cast("array<double>").alias("v"))
