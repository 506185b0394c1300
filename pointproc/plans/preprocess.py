"""Samples to spikes to bursts to rates, for every recording in one plan."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointproc.operators.signal import crossings, detect_blocks
from pointproc.operators.trains import bursts, channel_summary, drop_refractory
from pointproc.params import DEFAULTS, Params
from pointproc.session import cut_lineage
from pointproc.sources import store
from pointproc.sources.electrodes import electrodes


@dataclass(frozen=True)
class Preprocessed:
    spikes: DataFrame
    channels: DataFrame
    bursts: DataFrame
    summary: DataFrame


def preprocess(samples: DataFrame, params: Params = DEFAULTS, filtered: bool = True,
               expected: DataFrame | None = None) -> Preprocessed:
    """Filter, detect, thin, segment and summarise.

    The sampling rate and length of a recording come from its lowest channel.
    ``expected`` (recording_id, channel) names channels that should be there: one
    without usable samples has a summary row with missing counts and rates.
    """
    spike = params.spike
    # one task per block filters, detects and counts samples; its few rows feed all outputs
    blocks = cut_lineage(detect_blocks(samples, spike, params.filter if filtered else None))
    meta = blocks.groupBy("recording_id", "channel").agg(F.sum("n").alias("n"), F.max("fs").alias("fs"))
    first = meta.groupBy("recording_id").agg(F.min_by(F.struct("n", "fs"), "channel").alias("m"))
    length = first.select("recording_id", F.round(F.col("m.n") * 1e6 / F.col("m.fs")).cast("bigint").alias("duration_us"))
    channels = meta.select("recording_id", "channel").join(length, "recording_id")
    found = crossings(blocks).join(length, "recording_id")
    spikes = cut_lineage(drop_refractory(found, spike.refractory_us, params.block_us))
    b = params.burst
    burst_table = bursts(spikes, b.isi_max_us, b.isi_end_us, b.min_spikes, params.block_us)
    summary = channel_summary(channels, spikes, burst_table, params.rate_unit_us)
    if expected is not None:
        key = ["recording_id", "channel"]
        summary = expected.select(*key).join(summary, key, "full_outer")
    return Preprocessed(spikes, channels, burst_table, summary)


def preprocess_and_store(samples: DataFrame, recordings: DataFrame, root: str, params: Params = DEFAULTS,
                         overwrite: bool = False, filtered: bool = True, expected: Sequence[int] | None = None) -> DataFrame:
    """Process the recordings not stored yet and write their tables; returns what was done.

    Recordings without samples are left out, and reported by ``store.missing_sources``.
    A recording is replaced whole, so a run that broke off is simply repeated. The
    run's parameters are kept with each recording. ``expected`` are the channels each
    recording should have, by default those of the electrode layout.
    """
    spark = samples.sparkSession
    try:
        done = store.read_table(spark, root, "recordings")
    except AnalysisException as e:  # first run: nothing is stored
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        done = recordings.limit(0)
    todo = cut_lineage(store.pending(recordings, done, samples, overwrite))
    ids = todo.select("recording_id")
    layout = (electrodes(spark).select("channel") if expected is None else
              spark.createDataFrame([(int(c),) for c in expected], "channel int"))
    wanted = ids.join(layout, how="cross")  # a layout's fixed number of rows for each recording
    out = preprocess(samples.join(ids, "recording_id", "left_semi"), params, filtered, wanted)
    study = todo.select("recording_id", "study")
    for name, df in (("spikes", out.spikes), ("channels", out.channels), ("bursts", out.bursts),
                     ("channel_summary", out.summary)):
        store.write_table(df.join(study, "recording_id"), root, name)
    # the recordings row goes last: its presence marks a recording as complete
    final = todo.withColumn("schema_version", F.lit(params.schema_version)).drop("duration_us").join(
        out.channels.groupBy("recording_id").agg(F.max("duration_us").alias("duration_us")), "recording_id")
    used = json.dumps(asdict(params) | {"filtered": filtered}, sort_keys=True)
    store.write_table(final.withColumn("created_at", F.current_timestamp()).withColumn("parameters", F.lit(used)), root, "recordings")
    return todo
