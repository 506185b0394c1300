"""Table schemas of the normalised recording store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


STR, INT, LONG, DBL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

RECORDINGS = _struct(
    recording_id=STR, study=STR, condition=STR, pair_no=LONG, fs=DBL,
    duration_us=LONG, schema_version=STR,
)
# duration_us rides along on every spike: it is constant per recording (free in
# Parquet) and spares the operators a join back to `recordings`, whose key may
# hold a third of all spikes.
SPIKES = _struct(recording_id=STR, channel=INT, t_us=LONG, duration_us=LONG)
CHANNELS = _struct(recording_id=STR, channel=INT, duration_us=LONG)
SAMPLES = _struct(
    recording_id=STR, channel=INT, chunk_no=LONG, start_idx=LONG, fs=DBL,
    v=T.ArrayType(DBL),
)
CHANNEL_SUMMARY = _struct(
    recording_id=STR, channel=INT, n_spikes=LONG, spike_rate=DBL, n_bursts=LONG,
    burst_rate=DBL,
)
BURSTS = _struct(
    recording_id=STR, channel=INT, burst_no=LONG, start_idx=LONG, end_idx=LONG,
    start_us=LONG, end_us=LONG, n_spikes=LONG,
)
EDGES = _struct(recording_id=STR, i=INT, j=INT, w=DBL, peak_lag_us=LONG)

TABLES = {
    "recordings": RECORDINGS, "spikes": SPIKES, "channels": CHANNELS,
    "samples": SAMPLES, "channel_summary": CHANNEL_SUMMARY, "bursts": BURSTS,
    "edges": EDGES,
}

#: Columns that are never NULL in a stored row; the keys are folder names.
REQUIRED = {
    "recordings": ["duration_us", "schema_version"], "spikes": ["channel", "t_us", "duration_us"],
    "channels": ["channel", "duration_us"], "samples": ["channel", "chunk_no", "start_idx", "fs", "v"],
    "channel_summary": ["channel"], "bursts": ["channel", "burst_no", "start_idx", "end_idx", "start_us", "end_us", "n_spikes"],
    "edges": ["i", "j"],
}


def require_columns(df: DataFrame, *names: str, what: str = "input") -> DataFrame:
    """Return ``df`` unchanged, or raise when a needed column is absent."""
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"{what} is missing column(s): {', '.join(absent)}")
    return df
